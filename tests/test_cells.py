"""Names met in cells: the kernel against plain definitions, and many random names in a short time."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tonearm.functions.similarity import Names, best_window, common_length, ratio
from tonearm.operators import cascade, matching


def names_of(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdé x") for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_names_against_plain_common_lengths():
    for most in (5, 32, 33, 64, 65, 130, 300):
        block = Names(names_of(most, 40, most))
        for other in [*names_of(most + 1, 5, most), "", "zzz", "b" * 300]:
            every = slice(0, len(block.names))
            plain = [common_length(x, other) for x in block.names]
            assert block.common(other, every).tolist() == plain
            assert all(b >= n for b, n in zip(block.bound(other, every).tolist(), plain))
            at, found = block.meet(other, every, np.full(len(plain), 3))
            assert dict(zip(at.tolist(), found.tolist())) == {i: n for i, n in enumerate(plain) if n >= 3}


def sorted_words(x):
    return " ".join(sorted(x.split()))


def guarded(a, b):
    short, long_ = sorted((a, b), key=len)
    if len(short) < 4:
        return ratio(sorted_words(a), sorted_words(b))
    share, words = len(short) / len(long_), set(short.split())
    inside = len(words) >= 2 and words <= set(long_.split())
    return best_window(a, b) * (1.0 if share >= 0.5 else max(2 * share, 0.85) if inside else 2 * share)


def test_pairs_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(matching, "HELD", 16)
    monkeypatch.setattr(matching, "READ", 8)
    left = sorted({x.strip() for x in [*names_of(1, 60, 9), "one two", "abc"]} - {""})
    right = sorted({x.strip() for x in [*names_of(2, 50, 12), "and one more than two of these long words", "abc", "x"]} - {""})
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    for least in (60.0, 75.0, 100.0):
        got = {(r["a"], r["b"]): r["score"] for r in matching.name_pairs(a, b, least).collect()}
        assert got == {(x, y): s for x in left for y in right if (s := ratio(sorted_words(x), sorted_words(y))) >= least}
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in cascade.safe_pairs(a, b, 75.0).collect()}
    assert got == {(x, y): round(s, 9) for x in left for y in right if (s := guarded(x, y)) >= 75.0} and ("one two", "and one more than two of these long words") not in got


def test_many_random_names_in_time(spark):
    a = spark.range(12_000).select(F.md5(F.col("id").cast("string")).alias("a"))
    start = time.time()
    # Letter pairs tell nothing here: any two such names share some. Before, 40 s didn't do.
    assert matching.name_pairs(a, a.toDF("b"), 60.0).filter("a = b").count() == 12_000
    assert time.time() - start < 40
