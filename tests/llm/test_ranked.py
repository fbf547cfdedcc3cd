"""Bit-sliced search against scores computed one by one."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.fixtures import DOCS, awkward, docs_df
from tests.oracle import differences, tables
from tonearm.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, length = len(docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 100 - 25 + (25 * n * count) // length
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in Counter(terms(text)).items() if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def found(docs, items, **more):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(docs, items, **more).collect())


ASKED = [(1, "quick brown Fox, the lazy dog AND the dog"), (2, "alpha ALPHA alpha passage"), (3, None), (4, ""), (5, "nowhere-at-all!"), (6, "same"), (6, "same"), (None, "漢字 text ünïcödé"), (7, "x" * 5000)]


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs, items = docs_df(spark, extra=extra), spark.createDataFrame(ASKED, ITEMS)
    assert found(docs, items) == brute([(r[0], r[1]) for r in awkward()], ASKED)


def test_empty_tables(spark):
    items = spark.createDataFrame(ASKED, ITEMS)
    assert not found(docs_df(spark, []), items)
    assert not found(docs_df(spark, [(1, None, "en", "w", 0), (2, " .,", "en", "w", 3)]), items)
    assert not found(docs_df(spark), spark.createDataFrame([], ITEMS))


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 128, "_WORDS": 2, "ITEMS": 3, "TERMS": 5, "PIECE": 7}])
def test_many_ties_and_small_blocks(spark, monkeypatch, limits):
    """Limits reach the tasks only by the driver's pickled functions, so the local parts are tried apart."""
    for name, value in limits.items():
        monkeypatch.setattr(ranked, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, Counter(rng.choice(words, rng.integers(1, 40)).tolist())) for i in range(100)]
    items = [(i, Counter(rng.choice(words, rng.integers(1, 12)).tolist())) for i in range(11)]
    codes = {w: i for i, w in enumerate(words)}
    n = np.array([sum(c.values()) for _, c in docs])
    m = 75 + 25 * n * len(docs) // n.sum()
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * sum(w in c for _, c in docs) + 1))) for w in words])
    block = ranked.Block([np.array(sorted(codes[w] for w in c), dtype=np.int32) for _, c in docs], [np.array([c[w] for w in sorted(c, key=codes.get)]) for _, c in docs], m, weights)
    got = {}
    for at, entries, matrix in ranked.Items(items, codes).chunks:
        for i, d, s in zip(*map(np.ndarray.tolist, ranked.best(block.scores(entries, matrix), 7))):
            got.setdefault(at + i, []).append((-s, d))
    for i, (_, item) in enumerate(items):
        scores = [sum(q * weights[codes[w]] * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m[d])) for w, q in item.items() if c[w]) for d, (_, c) in enumerate(docs)]
        assert sorted(got.get(i, [])) == sorted((-int(s), d) for d, s in enumerate(scores) if s > 0)[:7]


def test_carry_arithmetic():
    rng = np.random.default_rng(4)
    numbers = rng.integers(0, 1 << 20, (9, 64 * ranked._WORDS))
    total = [np.zeros((1, ranked._WORDS), dtype=np.uint64) for _ in range(26)]
    for row in numbers:
        planes = np.packbits(((row[None, :] >> np.arange(20)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
        ranked.add(total, planes[None], np.array([0]))
    bits = [np.unpackbits(t.view(np.uint8), bitorder="little").astype(np.int64) for t in total]
    assert (sum(b << i for i, b in enumerate(bits)) == numbers.sum(axis=0)).all()


def test_ties_over_many_tasks_go_by_id(spark):
    rows = [(i, "one two" if i % 3 else "one two three", "en", "web", 7) for i in range(20000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    items = [(1, "two"), (2, "three one")]
    assert found(docs, spark.createDataFrame(items, ITEMS), k=5) == brute([(r[0], r[1]) for r in rows], items, 5)


def test_items_in_several_passes_and_text_ids(spark):
    docs = docs_df(spark).withColumn("doc_id", F_text())
    items = spark.createDataFrame(ASKED, ITEMS)
    once, many = found(docs, items), found(docs, items, most_bytes=20)
    assert once == many and {type(d) for _, _, d, _ in once} == {str}


def F_text():
    from pyspark.sql import functions as F

    return F.concat(F.lit("d"), F.col("doc_id").cast("string"))


def test_large_ids_stay_exact(spark):
    rows = [((1 << 60) + i, "word", "en", "web", 4) for i in range(30)] + [(None, "word other", "en", "web", 10)] + [(5, "other", "en", "web", 5)]
    items = [(1, "word other")]
    assert found(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)) == brute([(r[0], r[1]) for r in rows], items)


def test_query(spark):
    assert not differences(ranked.op12_search(spark, SF), tables(SF), ranked.OP12_SQL)
