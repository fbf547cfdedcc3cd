"""Faults that only larger tables showed, at a size that shows them."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tonearm import queries_more
from tonearm.functions.similarity import best_window, ratio
from tonearm.operators import cascade, library, matching, writeback
from tonearm.sources.tables import shared_folder


def home(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_many_batches_in_one_write(spark):
    where, calls = home(spark, "many"), []
    rows = spark.range(600).select("id")
    save = writeback.json_batches(f"{where}/out")

    def write(some, batches):
        if len(calls) == 2:
            calls.append("failed")
            raise OSError("the other side is gone")
        save(some, batches)
        calls.append(batches)

    with pytest.raises(OSError):
        writeback.write_back(rows, ["id"], 10, where, write, at_once=25)
    # What was written stays when later batches are.
    assert writeback.write_back(rows.limit(0), ["id"], 10, where, write, at_once=25) == {"written": 10, "before": 50}
    assert calls == [list(range(25)), list(range(25, 50)), "failed", list(range(50, 60))]
    out = spark.read.schema("id long, batch int").json(f"{where}/out")
    assert out.count() == 600 and out.filter("batch <> floor(id / 10)").count() == 0


def test_entries_beyond_a_million(spark):
    where = home(spark, "entries")
    line = [(1, 1000001, 2, 10.0, 0.1), (1, 5, 2, 3.0, 0.1), (1, 5, 2, 10.0, 0.1), (1, 6, 1, 10.0, 0.1)]
    spark.createDataFrame(line, "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{where}/lineitem.parquet")
    spark.createDataFrame([(1,), (1000001,)], "s_suppkey long").write.parquet(f"{where}/supplier.parquet")
    spark.createDataFrame([(5,), (6,), (1000001,), (1000005,)], "p_partkey long").write.parquet(f"{where}/part.parquet")
    got = sorted(map(tuple, queries_more.entries_refused(spark, where).collect()))
    assert got == [(1, 1000001, "track not found"), (1, 1000005, "track not found"), (1000001, 6, "list not found")]


def test_repairs_with_an_equal_partner_meet_no_others(spark, monkeypatch):
    met, weighed = [], cascade.weighed
    monkeypatch.setattr(cascade, "weighed", lambda mine, *rest: met.extend(r["file"] for r in mine.select("file").collect()) or weighed(mine, *rest))
    songs = [("f1", "The Band", "First Album"), ("f2", "the bant", "secont album"), ("f3", "the band", "q"), ("f4", "band the", "album third"), ("f5", "x", "y"), ("f6", None, "First Album")]
    tracks = spark.createDataFrame([(f, a, b, None, "flac") for f, a, b in songs], "file string, artist string, album string, title string, encoding string")
    releases = spark.createDataFrame([(7, "The Band", "First Album"), (8, "the band", "second album"), (5, "The Band", "Third Album"), (4, "the band", "third album")], "release_id long, band string, album string")
    none = spark.createDataFrame([], "release_id long, place int, title string")
    formats = spark.createDataFrame([], "release_id long, encoding string")
    got = {r["file"]: (r["release_id"], r["score"] and round(r["score"], 3), r["match_type"]) for r in cascade.repair_matches(tracks.select("file"), tracks, releases, none, formats).collect()}
    near = 0.4 * 100 * 7 / 8 + 0.6 * 100 * 11 / 12
    assert got == {"f1": (7, 100.0, "release"), "f2": (8, round(near, 3), "release"), "f4": (4, 100.0, "release"), **{f: (None, None, "none") for f in ("f3", "f5", "f6")}}
    # All six met all names before: f3 and f5 are too short for any album.
    assert met == ["f2"]


def test_single_files_meet_within_their_group(spark, monkeypatch):
    monkeypatch.setattr(matching, "HELD", 16)
    monkeypatch.setattr(matching, "READ", 8)
    monkeypatch.setattr(cascade, "name_pairs", None)
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(1, 7))).strip() or "a"
    albums = [(i, rng.choice(["one", "one", "two", "x"]), [name(), name()]) for i in range(60)]
    files = [(f"k{i}", rng.choice(["one", "one", "two", "y"]), "f", [name(), name()]) for i in range(80)]
    got = cascade.single_files(spark.createDataFrame(albums, "release_id long, sub string, albums array<string>"), spark.createDataFrame(files, "key string, sub string, folder string, names array<string>"), ["sub"], 75.0)
    words = lambda x: " ".join(sorted(x.split()))
    best = {(r, k): max(ratio(words(a), words(b)) for a in xs for b in ys) for r, s, xs in albums for k, t, _, ys in files if s == t}
    assert {(r["release_id"], r["key"]): r["score"] for r in got.collect()} == {at: s for at, s in best.items() if s >= 75.0}


def test_partial_candidates_within_groups(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() or "a"
    left, right = sorted({(rng.choice("xyz"), name()) for _ in range(80)}), sorted({(rng.choice("xyw"), name()) for _ in range(80)})
    # Long names only: their windows need no list.
    left, right = left + [("long", "abcdefgh")], right + [("long", "abcdefgx")]
    got = cascade.partial_pairs(spark.createDataFrame(left, "sub string, a string"), spark.createDataFrame(right, "sub string, b string"), 75.0, on=("sub",)).collect()
    pairs = {(s, a, b) for s, a in left for t, b in right if s == t}
    assert {x for x in pairs if best_window(*x[1:]) >= 75.0} <= {tuple(r) for r in got} <= pairs and len(got) == len({tuple(r) for r in got})


def test_lists_are_written_in_tasks_of_bounded_size(spark):
    rng = random.Random(7)
    links = [(rng.choice([1, 2, 3, None]), rng.choice([1, 2, None]), rng.choice([1, 2, 2, 3, None])) for _ in range(60)]
    removed = [(1, 1), (1, 1), (2, 2), (3, 7), (None, 1), (1, None)]
    df = spark.createDataFrame(links, "list_id long, track_id int, position int")
    out = library.remove_from_lists(df, spark.createDataFrame(removed, "list_id long, track_id long"), "list_id", tasks=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    left = list(links)
    for key in {r for r in removed if None not in r}:
        mine = sorted((x for x in left if x[:2] == key), key=lambda x: (x[2] is not None, x[2] or 0))
        if mine:
            left.remove(mine[0])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(left, key=repr) and out.schema == df.schema
    added = spark.createDataFrame([(1, 9, None), (1, 8, None), (4, 9, None), (2, 9, 50)], "list_id long, track_id int, position int")
    grown = library.append_to_lists(df, added, "list_id", tasks=5)
    last = max(p for i, _, p in links if i == 1 and p is not None)
    assert sorted(map(tuple, grown.collect()), key=repr) == sorted([*links, (1, 8, last + 1), (1, 9, last + 2), (4, 9, 1), (2, 9, 50)], key=repr)
    # Before, entries and removed ones were sorted twice, to be joined and to be numbered, in as many tasks at any size.
    assert "Join" not in plan and plan.count("Sort [") == 1 and "list_id#" in plan and ", 5)" in plan
