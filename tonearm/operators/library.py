"""Listings of a library: joins to children and parents, ordered lists, reports over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.media import below


def joined_names(child: DataFrame, key: str, value: str, name: str, sep: str = ", ") -> DataFrame:
    """A child table as one sorted text of distinct values per key, combined before the shuffle."""
    return child.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), sep).alias(name))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_of(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``, and ``more``: how many the group has beyond them."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)})
    return ranked.filter(F.col("rank") <= k).withColumn("more", F.greatest(F.col("_all") - k, F.lit(0))).drop("_all")


def status_counts(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole), digits), F.lit(0.0))


def run_deltas(runs: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """Each run with its change of every metric since the run before (runs are one small table)."""
    w = Window.orderBy(order)
    return runs.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in metrics})


def next_start(df: DataFrame, group: str, order: str, start: str) -> DataFrame:
    """Each row with ``end``: where the next row of its group starts."""
    return df.withColumn("end", F.lead(start).over(Window.partitionBy(group).orderBy(order)))


def batches(df: DataFrame, order: str, key: str, size: int) -> DataFrame:
    """``batch`` numbers rows of each ``key`` by runs of ``size``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def find_tracks(tracks: DataFrame, contains: dict[str, str] | None = None, bpm_range: tuple[float, float] | None = None, key: str | None = None, limit: int | None = None) -> DataFrame:
    """Tracks that are not deleted (a null flag counts as unknown and drops the row), whose named columns contain the given texts.

    Texts are compared without regard to case, with ``%`` and ``_`` live. A limit takes the least ids; 0 is no limit.
    """
    out = tracks.filter("deleted <> 1")
    for name, text in (contains or {}).items():
        out = out.filter(F.col(name).ilike(f"%{text}%"))
    if bpm_range:
        out = out.filter(F.col("bpm").between(*bpm_range))
    if key:
        out = out.filter(F.col("key") == key)
    return out.orderBy("id").limit(limit) if limit else out


def visible_playlists(playlists: DataFrame) -> DataFrame:
    """Playlists that are not hidden, by position."""
    return playlists.filter("hidden <> 1").orderBy("position", "id")


def visible_crates(crates: DataFrame) -> DataFrame:
    """Crates that are shown, by name."""
    return crates.filter("show = 1").orderBy("name")


def members(parents: DataFrame, links: DataFrame, tracks: DataFrame, parent_key: str, *order: str) -> DataFrame:
    """``parent_key``, the link's order columns and the tracks that a playlist or crate holds."""
    rows = links.select(parent_key, F.col("track_id").alias("id"), *order).join(parents.select(F.col("id").alias(parent_key)), parent_key, "left_semi")
    return rows.join(tracks, "id")


def track_metadata(tracks: DataFrame, locations: DataFrame, crate_tracks: DataFrame, crates: DataFrame, root: str, since_ms: int | None = None) -> DataFrame:
    """All columns of undeleted tracks with a file under ``root``, with file_path, relative_path and the sorted ``crates``.

    ``since_ms`` keeps tracks synchronised later, or at no known time. Crates are joined once, as a list for each track.
    """
    rows = tracks.filter("deleted <> 1")
    if since_ms is not None:
        rows = rows.filter((F.col("source_synchronized_ms") > since_ms) | F.col("source_synchronized_ms").isNull())
    paths = locations.select(F.col("id").alias("location"), F.col("location").alias("file_path")).filter("file_path <> ''")
    rows = rows.join(paths, "location").withColumn("relative_path", below(F.col("file_path"), root)).filter("relative_path is not null")
    names = crate_tracks.join(crates.select(F.col("id").alias("crate_id"), "name"), "crate_id").groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("crates"))
    return rows.join(names, "id", "left").withColumn("crates", F.coalesce("crates", F.array().cast("array<string>")))


def update_track(tracks: DataFrame, track_id, **values) -> DataFrame:
    """The table with the given columns of one track set; None leaves a column as it is, a rating is held within 0 and 5."""
    if values.get("rating") is not None:
        values["rating"] = max(0, min(5, values["rating"]))
    here = F.col("id") == F.lit(track_id)
    return tracks.withColumns({c: F.when(here, F.lit(v).cast(tracks.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def append_to_lists(links: DataFrame, added: DataFrame, parent_key: str, tasks: int | None = None) -> DataFrame:
    """``links(parent_key, track_id, position)`` with ``added(parent_key, track_id, position)``; rows without a position go to their list's end, by track.

    Lists are dealt into ``tasks``, where given, so that what a task sorts doesn't grow with the tables.
    """
    last = dealt(links.select(parent_key, "position"), tasks, parent_key).groupBy(parent_key).agg(F.max("position").alias("_last"))
    n = F.row_number().over(Window.partitionBy(parent_key, F.col("position").isNull()).orderBy("track_id"))
    rows = dealt(added, tasks, parent_key).withColumn("_n", n).join(last, parent_key, "left")
    rows = rows.withColumn("position", F.coalesce("position", F.coalesce("_last", F.lit(0)) + F.col("_n")).cast(links.schema["position"].dataType))
    return links.unionByName(rows.select(links.columns))


def remove_from_lists(links: DataFrame, removed: DataFrame, parent_key: str, tasks: int | None = None) -> DataFrame:
    """``links`` without the first entry, by position, of each ``removed(parent_key, track_id)``; later entries of the track stay.

    What is removed is sorted ahead of the entries, so one sort does for both; lists are dealt into ``tasks`` as in :func:`append_to_lists`.
    """
    keys = [parent_key, "track_id"]
    hit = removed.select(keys).dropna().withColumn("_hit", F.lit(True))
    rows = dealt(links.withColumn("_hit", F.lit(False)).unionByName(hit, allowMissingColumns=True), tasks, *keys)
    # The row before the first entry tells whether it goes; no row is before the first of those to stay.
    gone = F.lag("_hit", 1, False).over(Window.partitionBy(*keys).orderBy(F.desc("_hit"), "position"))
    kept = rows.withColumn("_gone", gone).filter(~F.col("_hit") & ~F.col("_gone"))
    return kept.select([F.col(c).cast(links.schema[c].dataType) for c in links.columns])


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def list_sizes(parents: DataFrame, links: DataFrame, parent_key: str) -> DataFrame:
    """Parents with ``count``, the entries they have; counted afresh, as a kept counter would drift."""
    counts = links.groupBy(F.col(parent_key).alias("id")).agg(F.count("*").alias("count"))
    return parents.drop("count").join(counts, "id", "left").fillna(0, ["count"])
