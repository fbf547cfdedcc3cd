"""New lists with dense ids, entries for lists, and what is wrong with those that can't be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.operators.library import append_to_lists
from tonearm.sources.tables import settled


def numbered(rows: DataFrame, order: list[str], name: str, start: Column | int = 1) -> DataFrame:
    """``rows`` with ``name``: whole numbers from ``start`` on in ``order``, without a gap.

    Rows are sorted into ranges, the ranges' counts (a row for each partition) give where each begins, and rows are numbered within their range, so no
    task numbers all of them. The ranges are kept, because another run over the same rows may cut them elsewhere.
    """
    ranged = settled(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    start = start if isinstance(start, Column) else F.lit(start)
    return ranged.withColumn("_place", place).join(F.broadcast(base), "_part").withColumn(name, (start + F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_place", "_base")


def _next(df: DataFrame, name: str) -> DataFrame:
    """One row: one more than the largest value, 1 of none."""
    return df.agg((F.coalesce(F.max(name), F.lit(0)) + 1).cast("long").alias("_next"))


def create_playlists(playlists: DataFrame, wanted: DataFrame) -> DataFrame:
    """``playlists(id, name, position, hidden)`` with those of ``wanted(seq, name, hidden)`` after them: ids and positions go on from the largest, in order of ``seq``."""
    first = F.broadcast(_next(playlists, "id").withColumnRenamed("_next", "_id").withColumn("_one", F.lit(1)))
    place = F.broadcast(_next(playlists, "position").withColumnRenamed("_next", "_position").withColumn("_one", F.lit(1)))
    new = numbered(wanted, ["seq"], "_n", 0).withColumn("_one", F.lit(1)).join(first, "_one").join(place, "_one")
    new = new.select((F.col("_id") + F.col("_n")).alias("id"), "name", (F.col("_position") + F.col("_n")).alias("position"), F.coalesce("hidden", F.lit(False)).cast("int").alias("hidden"))
    return playlists.unionByName(new.select(*[F.col(c).cast(playlists.schema[c].dataType).alias(c) for c in playlists.columns]))


def create_crates(crates: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``crates(id, name, count, show)`` with those of ``wanted(seq, name)``, empty and shown, and the wanted rows that can't be made with their ``error``.

    A crate's name stands once: names that exist are refused, and of equal new ones all but the first.
    """
    # A name that many ask for meets its first row by both columns, so no task gets all rows of a name.
    first = wanted.groupBy("name").agg(F.min("seq").alias("seq")).withColumn("_first", F.lit(True))
    known = crates.select("name").distinct().withColumn("_known", F.lit(True))
    judged = wanted.join(first, ["name", "seq"], "left").join(known, "name", "left")
    error = F.when(F.col("name").isNull() | (F.col("name") == ""), "no name").when(F.col("_known"), "exists").when(F.col("_first").isNull(), "repeated")
    judged = settled(judged.select("seq", "name", error.alias("error")))
    first = F.broadcast(_next(crates, "id").withColumn("_one", F.lit(1)))
    new = numbered(judged.filter("error is null"), ["seq"], "_n", 0).withColumn("_one", F.lit(1)).join(first, "_one")
    new = new.select((F.col("_next") + F.col("_n")).alias("id"), "name", F.lit(0).alias("count"), F.lit(1).alias("show"))
    return crates.unionByName(new.select(*[F.col(c).cast(crates.schema[c].dataType).alias(c) for c in crates.columns])), judged.filter("error is not null")


def judged_entries(entries: DataFrame, parents: DataFrame, tracks: DataFrame, parent_key: str) -> DataFrame:
    """``entries(parent_key, track_id, ...)`` with ``error``: ``list not found``, ``track not found`` or null; the list is looked for first."""
    lists = parents.select(F.col("id").alias(parent_key)).distinct().withColumn("_list", F.lit(True))
    here = tracks.select(F.col("id").alias("track_id")).distinct().withColumn("_track", F.lit(True))
    rows = entries.join(lists, parent_key, "left").join(here, "track_id", "left")
    error = F.when(F.col("_list").isNull(), "list not found").when(F.col("_track").isNull(), "track not found")
    return rows.withColumn("error", error).drop("_list", "_track")


def add_entries(links: DataFrame, entries: DataFrame, parents: DataFrame, tracks: DataFrame, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """``links`` with the entries that can be made, at their position or at their list's end, and the others with their ``error``."""
    judged = settled(judged_entries(entries, parents, tracks, parent_key))
    return append_to_lists(links, judged.filter("error is null").drop("error"), parent_key), judged.filter("error is not null")


def looked_up(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``wanted(key)``, each with ``error``: ``not found`` or ``not unique`` (then once, without values), or null."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    one = rows.join(counts.filter("_n = 1").select(key), key, "left_semi")
    found = wanted.select(key).distinct().join(counts, key, "left").join(one, key, "left")
    return found.withColumn("error", F.when(F.col("_n").isNull(), "not found").when(F.col("_n") > 1, "not unique")).drop("_n")
