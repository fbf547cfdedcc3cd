"""Fuzzy pairs, however many names there are."""

import random

from tests.conftest import SF
from tonearm import queries as library
from tonearm.functions.similarity import ratio
from tonearm.operators import matching
from tonearm.sources.tables import table


def names():
    r = random.Random(6)
    words = ["gizmo", "lantern", "amber", "quay", "violet hour", "aa", "aaa", "b", "naïve", "\U0001f600 song", "", "banana"]
    out = set(words) | {"gizmoo", "sun flower", "sunflower", "lanterm"}
    while len(out) < 150:
        name = list(" ".join(r.sample(words, r.randint(1, 3))))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(name))
            name[at : at + r.randint(0, 1)] = r.choice(["", "a", "z", " "])
        out.add("".join(name))
    return sorted(out)


def test_name_pairs_lose_no_pair(spark):
    own = names()
    df = spark.createDataFrame([(x,) for x in own], "name string")
    plain = {x: " ".join(sorted(x.split())) for x in own}
    for least in (80, 60):
        want = {(x, y) for x in own for y in own if ratio(plain[x], plain[y]) >= least}
        got = [(r["a"], r["b"]) for r in matching.name_pairs(df, df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert ("gizmo", "gizmoo") in want


def test_urls_of_whole_tables_meet(spark):
    keys = lambda t, k: [r[0] for r in table(spark, SF, t).select(k).collect()]
    want = {(c, s) for c in keys("customer", "c_custkey") for s in keys("supplier", "s_suppkey") if c // 3 == s // 2 * 2}
    got = [(r["c_custkey"], r["s_suppkey"]) for r in library.QUERIES["match_by_url_all"](spark, SF).collect()]
    assert want and len(got) == len(want) and set(got) == want
