"""Reading tables and text logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The table computed once and kept in the shared folder, where it outlives executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read back: it outlives executors, its plan ends there, and its size is known. The end of the driver's JVM drops it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def attribute_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Change-log files as (key, line_no, line); the key is the file's name without ``.log.met``."""
    whole = spark.read.format("text").option("wholetext", True).load(glob).select("value", F.col("_metadata.file_path").alias("path"))
    lines = whole.select(F.regexp_extract("path", r"([^/]+?)(?:\.log\.met)?$", 1).alias("key"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.filter(F.trim("line") != "")


def with_declared(df: DataFrame, declared: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds declared columns that older files lack, with their types and defaults."""
    return df.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in declared.items() if c not in df.columns})


def key_files(lines: DataFrame) -> DataFrame:
    """Tab-separated ``key, file`` lines (with ``line_no``); the last line of a key counts."""
    part = F.split("line", "\t", 2)
    return lines.filter(F.contains(F.col("line"), F.lit("\t"))).groupBy(part[0].alias("key")).agg(F.max_by(part[1], "line_no").alias("file"))


def clear_tables(spark: SparkSession, home: str, derived: list[str]) -> list[str]:
    """Deletes the named tables below ``home`` that can be built again, and no others; returns those that were there."""
    jvm, conf, gone = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in derived:
        path = jvm.org.apache.hadoop.fs.Path(f"{home}/{name}")
        if path.getFileSystem(conf).delete(path, True):
            gone.append(name)
    return gone
