"""Balanced shards: every row once, even sizes, whole groups, gapless slots; quotas and seats by themselves."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.fixtures import DOCS, docs_df
from tonearm.llm import sharding


def texts(n, groups, seed=5):
    """``n`` different texts and groups of (copies, words), in mixed order."""
    rng = random.Random(seed)
    out = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(1, 40))) + f" {i}" for i in range(n)]
    for g, (copies, words) in enumerate(groups):
        out += [f"group {g} " + "word " * words] * copies
    rng.shuffle(out)
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(out)]


def checked(rows, out, shards):
    """Sizes by shard and shards by text, once all that must hold does."""
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(by) == len(rows)
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for i, t, *_ in rows:
        r, data = by[i], (t or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, crc32(data)) and 0 <= r["shard"] < shards
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, where


def test_groups_stay_whole_and_sizes_even(spark):
    rows = texts(900, [(2, 9)] * 150 + [(3, 5)] * 40 + [(7, 20)] * 10)
    sizes, where = checked(rows, sharding.shard_documents(spark.createDataFrame(rows, DOCS), 8).collect(), 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert sum(len(w) > 1 for w in where.values()) <= 2


def test_a_group_of_a_third_takes_few_shards(spark):
    rows = texts(600, [(1100, 12), (40, 9)] + [(2, 9)] * 100)
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 16).collect()
    sizes, where = checked(rows, out, 16)
    mean, hot = sum(sizes.values()) / 16, "group 0 " + "word " * 12
    need = 1100 * (len(hot) + 1) / mean
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert len(where[hot]) <= need + 1.5 and len(where["group 1 " + "word " * 9]) == 1


def test_links_alone_leave_no_room(spark):
    """Every document has a copy, so nothing is free to even the sizes out."""
    rows = texts(0, [(2, 3 + g % 17) for g in range(400)])
    sizes, where = checked(rows, sharding.shard_documents(spark.createDataFrame(rows, DOCS), 8).collect(), 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.03 * mean and sum(len(w) > 1 for w in where.values()) < 40


def test_rounds_cut_fewer_edges(spark):
    rows = texts(1200, [(2, 5)] * 150)
    docs = spark.createDataFrame(rows, DOCS)
    cut = [sum(len(w) - 1 for w in checked(rows, sharding.shard_documents(docs, 8, rounds=n).collect(), 8)[1].values()) for n in (0, 8)]
    assert cut[0] > 100 and cut[1] <= 5


def test_quotas_keep_to_room():
    rng = np.random.default_rng(1)
    for _ in range(50):
        wanted, room = rng.integers(0, 1000, (6, 6)).astype(float), rng.integers(0, 800, 6).astype(float)
        goes = sharding.quotas(wanted, room)
        flow = goes * wanted
        assert (goes >= 0).all() and (goes <= 1 + 1e-9).all()
        assert (flow.sum(axis=0) - flow.sum(axis=1) <= room + 1).all()
    free = np.array([[0.0, 10.0], [10.0, 0.0]])
    assert (sharding.quotas(free, np.zeros(2)) * free == free).all()  # an exchange needs no room


def test_seats_and_open_room():
    placed, left = sharding.seats([(1, 250), (2, 60), (3, 30)], 4, 100.0)
    assert placed == {1: [(0, 100.0), (1, 200.0), (2, 250.0)], 2: [(3, 60.0)], 3: [(3, 90.0 - 60.0)]}
    assert left.tolist() == [0, 0, 50, 10]
    assert sharding.open_room(np.array([5.0, 1.0, 3.0]), 4).tolist() == [0, 3, 1]


def test_one_text_only_and_empty_table(spark):
    rows = [(i, None if i % 2 else "", "en", "web", 0) for i in range(40)]
    sizes, _ = checked([(i, t or "", *x) for i, t, *x in rows], sharding.shard_documents(spark.createDataFrame(rows, DOCS), 4).collect(), 4)
    assert set(sizes.values()) == {10}
    assert sharding.shard_documents(docs_df(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op11_sharding"])
def test_query(spark, name):
    out = sharding.op11_sharding(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    _, where = checked(docs, out.collect(), 16)
    assert all(len(w) == 1 for w in where.values())
