"""The audit of filters against all 120 orders applied one by one."""

import re
from collections import Counter
from itertools import permutations

from tests.conftest import SF
from tests.llm.fixtures import DOCS, awkward, docs_df
from tests.oracle import differences, tables
from tonearm.llm import filters

LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (999, 1, 1), (20, 1, 0)]
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, _, part, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(set("#$%&*|") & set(t)), i is not None and first[t] < i]
        docs.append((part or "", {c for c, bad in zip("ABCDE", fails) if bad}, any(x == i and i is not None and q == 1 for x, q, _ in labels), any(x == i and i is not None and q == 1 for x, _, q in labels)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                shapley[part, c] += len(gone)
                redundant = sum(c in d[1] and bool(d[1] & set(order[: step - 1])) for d in own)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(d[1] == {c} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels=LABELS):
    rows = filters.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_awkward_rows(spark):
    assert audited(spark, docs_df(spark)) == audited(spark, docs_df(spark, extra=True)) == brute(awkward(), LABELS)


def test_many_masks(spark):
    """Texts that fail every set of filters, with copies, white space at the ends, and blanks that are not white space."""
    rows = []
    for n in range(400):
        words = [f"w{i}" for i in range(60 if n % 2 else 10)] if n % 3 else ["again"] * (60 if n % 2 else 10)
        text = " \t".join(words) + (" UPPER CASE" * 9 if n % 5 < 2 else "") + (" 5 % off" if n % 7 < 3 else "") + ("\n" * (n % 2)) + (" \x1c\x85 " if n % 4 == 0 else "")
        rows.append((n, text, "en", None if n % 11 == 0 else f"s{n % 3}", 1))
    assert audited(spark, spark.createDataFrame(rows, DOCS)) == brute(rows, LABELS)


def test_empty_tables(spark):
    assert audited(spark, docs_df(spark, [])) == {}
    assert audited(spark, docs_df(spark), []) == brute(awkward(), [])


def test_no_python_on_the_way(spark):
    plan = filters.op13_filters(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_query(spark):
    assert not differences(filters.op13_filters(spark, SF), tables(SF), filters.OP13_SQL)
