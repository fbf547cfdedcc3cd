"""Early stops on pages that grow with the table."""

from tests.conftest import SF
from tonearm import queries as library
from tonearm.sources.tables import table


def test_early_stop_returns_half_of_the_page(spark):
    ids = [r[0] for r in table(spark, SF, "events").select("event_id").collect()]
    got = sorted(r["event_id"] for r in library.QUERIES["cdc_early_stop_half"](spark, SF).collect())
    assert got == sorted(i for i in ids if 2 * i <= max(ids)) and len(got) > len(ids) // 3
