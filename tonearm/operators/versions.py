"""Tables that are built in versions: only what changed is replayed, and a reader sees a version whole or not at all.

A table's rows lie in buckets by a hash of their key, each bucket in a folder of its own. A new version writes the buckets that hold changed keys to new folders
and then one pointer row, which names every bucket's folder. Readers follow the last pointer, so a run that ends between the two
leaves the version before as it was, and the same run can be repeated. Old folders stay until :func:`drop_unused`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.changelog import changed_keys
from tonearm.sources.tables import settled

POINTER = "version bigint, source string, at timestamp, changed bigint, total bigint, folders map<int,string>"


class KeyedTable:
    """A table by ``key`` in ``home``; ``schema`` holds the key. Null keys aren't kept.

    A pointer names ``buckets`` folders at most, and a run rewrites those that it touches, so there should be as many as keep one to some gigabytes.
    """

    def __init__(self, spark: SparkSession, home: str, schema: str, key: str = "key", buckets: int = 64):
        self.spark, self.home, self.schema, self.key, self.buckets = spark, home, schema, key, buckets

    def pointer(self) -> Row | None:
        """The last version's row, with the time it was written, the number of keys it changed and of those changed so far; one row a version is read."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/versions")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.schema(POINTER).parquet(f"{self.home}/versions").orderBy(F.desc("version")).limit(1).collect()
        return rows[0] if rows else None

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the last version, or those of some buckets."""
        now = self.pointer()
        folders = [f for b, f in sorted((now.folders if now else {}).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def replace(self, changed: DataFrame, fresh: DataFrame, source: str) -> int:
        """A new version in which the rows of ``changed(key)`` are ``fresh``, or gone where there are none. Returns the number of changed keys."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        keys = changed.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        touched = {r["bucket"]: r["n"] for r in keys.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()}
        now = self.pointer()
        folders = dict(now.folders) if now else {}
        if touched:
            old = self.read(list(touched)).join(keys, self.key, "left_anti")
            rows = old.unionByName(fresh.select(old.columns).filter(F.col(self.key).isNotNull())).withColumn("_bucket", bucket)
            run = f"{self.home}/data/{uuid.uuid4().hex}"
            # Small buckets share tasks and large ones split, by the sizes that come up.
            rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(run)
            made = {r["_bucket"] for r in self.spark.read.schema(f"{self.schema}, _bucket int").parquet(run).select("_bucket").distinct().collect()}
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{run}/_bucket={b}" for b in made}
        self.point(now, source, sum(touched.values()), folders)
        return sum(touched.values())

    def point(self, now: Row | None, source: str, changed: int, folders: dict[int, str]) -> None:
        """Writes the pointer; the version exists from here on."""
        row = self.spark.createDataFrame([((now.version if now else 0) + 1, source, None, changed, (now.total if now else 0) + changed, folders)], POINTER)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.home}/versions")


def drop_unused(table: KeyedTable) -> int:
    """Deletes the folders that the last version doesn't name, those of broken runs too; nothing may be reading an older one. Returns their number."""
    jvm, conf = table.spark.sparkContext._jvm, table.spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{table.home}/data")
    files, now = root.getFileSystem(conf), table.pointer()
    if not files.exists(root):
        return 0
    used = {tuple(f.rsplit("/", 2)[1:]) for f in (now.folders.values() if now else ())}
    gone = 0
    for run in files.listStatus(root):
        for part in files.listStatus(run.getPath()):
            name = part.getPath().getName()
            if name.startswith("_bucket=") and (run.getPath().getName(), name) not in used:
                files.delete(part.getPath(), True)
                gone += 1
    return gone


def refresh(table: KeyedTable, seen: KeyedTable, source: str, files: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> int | None:
    """Brings ``table`` to the version ``source`` of its logs: None if it is there already, else the number of keys that changed.

    ``files(key, stamp)`` lists the logs with what tells that one has changed, and ``seen`` keeps the list of the last run, which moves last; ``rows_of`` makes the
    rows of the logs whose keys it is given. Without an earlier run all keys are new. Where no log changed the watermark moves all the same. Keys
    whose logs are gone lose their rows.
    """
    now = seen.pointer()
    if now and now.source == source:
        return None
    files = files.select(F.col("key").cast("string").alias("key"), F.col("stamp").cast("string").alias("stamp"))
    changed = settled(changed_keys(seen.read(), files, "key", "stamp"))
    here = changed.filter("change <> 'removed'").select("key")
    if not changed.isEmpty():
        table.replace(changed, rows_of(here), source)
    return seen.replace(changed, files.join(here, "key", "left_semi"), source)
