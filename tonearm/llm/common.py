"""Helpers that several corpus operators share: fold rules, shared storage and byte-level tokens."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Only a local master may go without; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tonearm-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, so its lineage ends there.

    The table outlives lost executors; :func:`discard` or the end of the session's JVM drops it. Shuffle files of the step that
    has ended can go at once: Spark drops them when the JVM's collector has seen that nothing refers to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonearm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    target, fs = _file(spark, path)
    fs.deleteOnExit(target)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`stored` wrote and that nothing will read again."""
    target, fs = _file(df.sparkSession, df._stored_at)
    fs.delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def with_order(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None, dense: bool = False) -> DataFrame:
    """``id``, ``text``, ``other`` (a struct of the columns to carry) and ``rid``, a unique long in the documents' order.

    Ids are of any type that sorts. Unique whole numbers serve as they are, unless ``dense`` numbers are asked for. Otherwise, and where ids repeat or are null (null ones come first), rows are
    numbered by (id, a hash of the text, text) and then by a hash of what they carry; repeats of a row come after it. How many rows
    each id has in each of 4,096 buckets of the hash is counted first; these counts are sorted over the cluster, and a range's number of rows begins
    where the ranges before it end. So no task sees all rows, or all of one id, and no expression grows with the number of partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])]).alias("other"))
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    odd = dense or not whole or rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).count()
    if not odd:
        return rows.select("id", "text", "other", F.col("id").cast("long").alias("rid"))
    keyed = rows.withColumn("key", F.md5("text")).withColumn("bucket", F.substring("key", 1, 3))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = keyed.groupBy("id", "bucket").agg(F.count("*").alias("n"))
    # Stored, because the ranges of another run over the same rows may differ.
    sums = stored(sums.repartitionByRange(parts, "id", "bucket").withColumn("part", F.spark_partition_id()), "order")
    base = sums.groupBy("part").agg(F.sum("n").alias("all"))
    base = base.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("id", "bucket")) - F.col("n")
    # A row for each partition at most.
    begin = sums.withColumn("within", within).join(F.broadcast(base), "part").select(F.col("id").alias("_id"), F.col("bucket").alias("_bucket"), (F.col("base") + F.col("within")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("id", "bucket").orderBy("key", "text", F.xxhash64(F.to_json("other")))) - 1
    placed = keyed.withColumn("place", place).join(begin, F.col("id").eqNullSafe(F.col("_id")) & (F.col("bucket") == F.col("_bucket")))
    return placed.select("id", "text", "other", (F.col("begin") + F.col("place")).alias("rid"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, extra: tuple = ()) -> list:
    """At most ``max_rows`` labelled texts, chosen by a hash of their ids; the only rows a classifier sees.

    ``keep`` is a condition on ``doc_id``. Labels that are null or repeat an id (the first by value
    stays), texts that are null and ids without a document are left out. The bound makes the broadcast
    and the driver's copy safe at any corpus size.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", *extra)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", *extra)
    # Where ids repeat there are more texts than labels; the same max_rows of them stay in every run.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text"), *extra).limit(max_rows).collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["text"]))


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_logistic(x, y, l2: float = 1e-3, rounds: int = 60):
    """Weights (intercept last) of a logistic regression by Newton's method; rows of ``x`` are examples."""
    import numpy as np

    a = np.column_stack([np.asarray(x, dtype=float), np.ones(len(y))])
    y = np.asarray(y, dtype=float)
    w = np.zeros(a.shape[1])
    damp = l2 * np.eye(a.shape[1]) * max(1, len(y))
    damp[-1, -1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + damp, a.T @ (p - y) + damp @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w
