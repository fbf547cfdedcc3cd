"""Reports as JSON, JSON lines and CSV; each is written whole by Spark's committers, so readers never see a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A one-row summary and, beside it, the results; results stay spread over files."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def read_results(spark: SparkSession, path: str, schema: str, statuses: tuple[str, ...] = ()) -> DataFrame:
    """A report's results, or only those with the given statuses (such as error, for repairs)."""
    out = spark.read.schema(schema).json(f"{path}/results")
    return out.filter(F.col("status").isin(*statuses)) if statuses else out


def append_metrics(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").json(path)


def last_metrics(spark: SparkSession, path: str, schema: str, order: str = "timestamp", last: int | None = None) -> DataFrame:
    """The latest runs in time order."""
    runs = spark.read.schema(schema).json(path)
    return (runs.orderBy(F.desc(order)).limit(last) if last else runs).orderBy(order)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def paths_only(df: DataFrame, path_col: str) -> DataFrame:
    """One path a line; a missing one is an empty line."""
    return df.select(F.coalesce(F.col(path_col), F.lit("")).alias("value"))


def json_summary(rows: DataFrame, order: str, name: str, **fixed) -> DataFrame:
    """One row with ``json``: how many rows there are, and the rows as an array in order, null fields too.

    The array is one value, so it is for listings that a reader takes whole, such as releases that are missing; :func:`write_report` keeps rows spread over files.
    """
    each = F.struct(*[F.col(c) for c in rows.columns])
    listed = rows.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), each.alias("r")))).alias("_all"))
    made = F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], F.col("count"), F.transform("_all", lambda x: x["r"]).alias(name))
    return listed.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("json"))


def failed_files(report: DataFrame) -> DataFrame:
    """(file, error) of a check report's failures: the tools' outputs, each cut to 100 characters, in order; ``report(results)`` holds (file, status, errors(tool, output))."""
    rows = report.select(F.explode("results").alias("r")).filter(F.col("r.status") == "error")
    texts = F.transform("r.errors", lambda e: F.concat(e["tool"], F.lit(": "), F.substring(F.coalesce(e["output"], F.lit("")), 1, 100)))
    return rows.select(F.col("r.file").alias("file"), F.array_join(texts, "; ").alias("error"))
