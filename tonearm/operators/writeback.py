"""Changes written to another system in batches; a run that broke off goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonearm.operators.lists import numbered


def _is_there(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def write_back(changes: DataFrame, order: list[str], size: int, home: str, write: Callable[[DataFrame, int | list[int]], None], at_once: int = 1) -> dict[str, int]:
    """Hands the rows of ``changes`` to ``write(rows, batch)``, ``size`` at a time in ``order``; returns how many batches were written and how many had been before.

    The first run stores the plan, the rows with their batch, below ``home``; later runs follow it, whatever has become of ``changes``, so a batch always has the same rows.
    After each batch its number goes to a ledger. A rerun leaves out what the ledger names, so no batch is written twice, save one whose write ended and whose
    entry did not: ``write`` must give the same result if it gets the same batch again. :func:`json_batches` does.

    With ``at_once`` above 1, ``write(rows, batches)`` gets that many batches in one call, in a list, and rows that keep their ``batch``; they go to the ledger together,
    and a run that breaks off writes them all again.
    """
    spark, plan, ledger = changes.sparkSession, f"{home}/plan", f"{home}/ledger"
    if not _is_there(spark, f"{plan}/_SUCCESS"):
        rows = numbered(changes, order, "_n", 0)
        rows.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n").hint("rebalance", "batch").write.mode("overwrite").partitionBy("batch").parquet(plan)
    planned = spark.read.schema(StructType([*changes.schema.fields, StructField("batch", LongType())])).parquet(plan)
    batches = planned.select("batch").distinct()
    done = spark.read.schema("batch long").parquet(ledger) if _is_there(spark, ledger) else spark.createDataFrame([], "batch long")
    before = done.distinct().count()
    written = 0
    # The batches' numbers come to the driver a partition at a time; each call's are one commit.
    waiting = batches.join(done.distinct(), "batch", "left_anti").orderBy("batch").toLocalIterator()
    for some in batched((row["batch"] for row in waiting), at_once):
        if at_once == 1:
            write(planned.filter(F.col("batch") == some[0]).drop("batch"), some[0])
        else:
            write(planned.filter(F.col("batch").isin(*some)), list(some))
        spark.createDataFrame([(n,) for n in some], "batch long").coalesce(1).write.mode("append").parquet(ledger)
        written += len(some)
    return {"written": written, "before": before}


def json_batches(folder: str) -> Callable[[DataFrame, int | list[int]], None]:
    """Writes each batch as JSON lines to a folder of its own, which a repeat replaces; many batches in one job."""

    def write(rows: DataFrame, batch: int | list[int]) -> None:
        if isinstance(batch, list):
            # Only the folders of these batches are replaced.
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(folder)
        else:
            rows.write.mode("overwrite").json(f"{folder}/batch={batch}")

    return write
