"""Versioned tables, merged streams, batches with a ledger, status moves: what happens when a run breaks off or is repeated."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from tonearm.operators import moves, versions, writeback
from tonearm.operators.changelog import current_values, operations
from tonearm.sources.tables import shared_folder
from tonearm.streaming import refresh

LINES = "key string, line_no long, line string"


def home(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def logs(spark, rows):
    return spark.createDataFrame([(k, n, f"1700000000s {text}") for k, n, text in rows], LINES)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


class Build:
    def __init__(self, spark):
        self.spark, where = spark, home(spark)
        self.data = versions.KeyedTable(spark, f"{where}/data", "key string, field string, value string", buckets=4)
        self.seen = versions.KeyedTable(spark, f"{where}/seen", "key string, stamp string", buckets=4)
        self.asked = []

    def run(self, source, rows):
        lines = logs(self.spark, rows)

        def made(keys):
            self.asked.append({r["key"] for r in keys.collect()})
            return current_values(operations(lines.join(keys, "key", "left_semi")))

        return versions.refresh(self.data, self.seen, source, lines.groupBy("key").agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list("line")))).alias("stamp")), made)


ONE = [("a", 1, "artist +A"), ("b", 1, "artist +B genre +x"), ("c", 1, "artist +C")]
TWO = [("a", 1, "artist +A"), ("b", 1, "artist +B genre +x"), ("b", 2, "artist -B +BB"), ("d", 1, "artist +D")]
AFTER = [("a", "artist", "A"), ("b", "artist", "BB"), ("b", "genre", "x"), ("d", "artist", "D")]


def test_only_changed_keys_are_replayed_and_gone_ones_go(spark):
    b = Build(spark)
    assert b.run("v1", ONE) == 3 and b.run("v1", ONE) is None
    assert b.run("v2", TWO) == 3 and b.asked == [{"a", "b", "c"}, {"b", "d"}]
    assert rows_of(b.data.read()) == AFTER
    assert b.run("v3", TWO) == 0 and b.seen.pointer().source == "v3" and len(b.asked) == 2
    assert (b.seen.pointer().version, b.seen.pointer().total) == (3, 6) and rows_of(b.data.read()) == AFTER


@pytest.mark.parametrize("broken", ["data", "seen"])
def test_a_crash_before_the_pointer_loses_nothing(spark, monkeypatch, broken):
    b = Build(spark)
    b.run("v1", ONE)
    before = rows_of(b.data.read())

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(getattr(b, broken), "point", crash)
        with pytest.raises(OSError):
            b.run("v2", TWO)
    assert b.seen.pointer().source == "v1" and rows_of(b.data.read()) == (before if broken == "data" else AFTER)
    assert b.run("v2", TWO) == 3 and rows_of(b.data.read()) == AFTER
    assert versions.drop_unused(b.data) > 0 and versions.drop_unused(b.data) == 0 and rows_of(b.data.read()) == AFTER


def test_null_keys_and_empty_tables(spark):
    t = versions.KeyedTable(spark, home(spark), "key string, v int")
    assert t.pointer() is None and t.read().collect() == [] and versions.drop_unused(t) == 0
    rows = spark.createDataFrame([("a", 1), (None, 2)], "key string, v int")
    assert t.replace(rows, rows, "s") == 1 and rows_of(t.read()) == [("a", 1)]
    assert t.replace(rows.select("key"), rows.limit(0), "s") == 1 and t.read().collect() == [] and t.pointer().folders == {}


def test_stream_merges_batches_without_older_logs(spark):
    where = home(spark)
    table = versions.KeyedTable(spark, f"{where}/data", refresh.LAST, buckets=4)
    jvm = spark.sparkContext._jvm
    for rows in (TWO[2:], TWO[:2], TWO[1:3]):
        logs(spark, rows).coalesce(1).write.mode("append").parquet(f"{where}/logs")
        refresh.follow_changes(spark, f"{where}/logs", LINES, table, f"{where}/progress").awaitTermination()
        # What has been read may go: nothing reads it again.
        path = jvm.org.apache.hadoop.fs.Path(f"{where}/logs")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for f in files.listStatus(path):
            files.delete(f.getPath(), True)
    assert rows_of(refresh.standing(table)) == AFTER


def test_write_back_goes_on_after_a_failure(spark):
    where, got, failing = home(spark), [], [2]
    rows = spark.range(25).select(F.col("id").cast("string").alias("file"), F.lit("v").alias("value"), "id")

    def write(batch, n):
        if failing and n == failing[0]:
            failing.clear()
            raise OSError("the other side is gone")
        got.append((n, sorted(r["id"] for r in batch.collect())))

    with pytest.raises(OSError):
        writeback.write_back(rows, ["id"], 10, where, write)
    assert [n for n, _ in got] == [0, 1]
    # The plan stays as it was, whatever the table is now.
    assert writeback.write_back(rows.limit(0), ["id"], 10, where, write) == {"written": 1, "before": 2}
    assert got == [(0, list(range(10))), (1, list(range(10, 20))), (2, list(range(20, 25)))]
    assert writeback.write_back(rows, ["id"], 10, where, write) == {"written": 0, "before": 3}


def test_moves_touch_three_columns_and_replays_change_nothing(spark):
    at = datetime.datetime(2024, 1, 1)
    table = spark.createDataFrame([("a", "Album A", "pending", None, None), ("b", "Album B", "downloaded", "p", at)], "key string, album string, status string, path string, at timestamp")
    events = spark.createDataFrame([("a", 2, "downloaded", "out/a", at), ("a", 1, "pending", "x", at), ("b", 1, "pending", "y", at), ("c", 1, "lost", "z", at), ("c", 2, "pending", "w", at), ("a", 3, "downloaded", "again", at)], "key string, seq long, status string, path string, at timestamp")
    judged = moves.moves(events, table)
    assert {(r["key"], r["seq"]): (r["before"], r["reason"]) for r in judged.collect()} == {
        ("a", 1): ("pending", "repeated"), ("a", 2): ("pending", "moved"), ("a", 3): ("downloaded", "repeated"), ("b", 1): ("downloaded", "illegal"), ("c", 1): (None, "unknown"), ("c", 2): (None, "moved")}
    once = moves.moved_rows(table, judged)
    want = [("a", "Album A", "downloaded", "out/a", at), ("b", "Album B", "downloaded", "p", at), ("c", None, "pending", "w", at)]
    assert sorted(map(tuple, once.collect()), key=lambda r: r[0]) == want
    assert sorted(map(tuple, moves.moved_rows(once, moves.moves(events, once)).collect()), key=lambda r: r[0]) == want
