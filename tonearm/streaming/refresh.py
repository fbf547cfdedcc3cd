"""A change-log folder followed as a stream: each batch is merged into what is known of its keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.changelog import operations
from tonearm.operators.versions import KeyedTable
from tonearm.sources.tables import settled, shared_folder

LAST = "key string, field string, value string, op string, line_no bigint, pos int"


def last_operations(ops: DataFrame) -> DataFrame:
    """The last operation on each value with its place, so that logs may be replayed piece by piece."""
    last = F.max(F.struct("line_no", "pos", "op")).alias("m")
    return ops.filter("op is not null").groupBy("key", "field", "value").agg(last).select("key", "field", "value", "m.op", "m.line_no", "m.pos")


def follow_changes(spark: SparkSession, log_dir: str, schema: str, table: KeyedTable, checkpoint: str):
    """Starts a stream of (key, line_no, line) files that ends once all are read; ``table`` has the columns ``LAST``.

    A batch reads its own lines and the known last operations of its keys, never older logs; the later operation stays, whichever comes first. So a batch that
    is run again changes nothing, and only the buckets that hold its keys are written. Values that stand are those of :func:`standing`.
    """
    lines = spark.readStream.schema(schema).parquet(log_dir)

    def apply(batch: DataFrame, number: int) -> None:
        new = settled(last_operations(operations(batch.withColumn("key", F.col("key").cast("string")))))
        keys = new.select("key").distinct()
        known = table.read().join(keys, "key", "left_semi")
        table.replace(keys, last_operations(known.unionByName(new.select(known.columns))), f"batch {number}")

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(table: KeyedTable) -> DataFrame:
    """(key, field, value) after all batches."""
    return table.read().filter("op = '+'").select("key", "field", "value")


def hourly_counts(spark: SparkSession, path: str, ts: str, kind: str, lateness: str = "1 hour") -> DataFrame:
    """``start``, ``kind`` and ``n``: rows per hour and kind, by a windowed aggregation with a watermark over a file stream.

    The stream ends once all files are read. Each batch replaces the counts of the hours that it changed, so a batch
    that is run again gives the same table; the table and the stream's progress lie in the shared checkpoint folder.
    """
    home = f"{shared_folder(spark)}/hourly-{uuid.uuid4().hex}"
    # As a pattern, the path may name a file as well as a folder.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(ts, F.col(ts).cast("timestamp"))
    counts = rows.withWatermark(ts, lateness).groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{home}/counts/run={number}")

    counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/counts").groupBy("start", kind).agg(F.max_by("n", "batch").alias("n"))
