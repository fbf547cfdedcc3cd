"""Status moves of rows by key: only legal ones count, in their order, and change three columns of what is known."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moves that a release may make; None is a release that isn't known yet.
MIRROR = {None: ("pending", "downloaded"), "pending": ("downloaded",), "downloaded": ()}
MOVE = "key string, seq long, before string, after string, path string, at timestamp, reason string"


def judged(status: str | None, rows: Iterable[tuple], legal: dict) -> Iterator[tuple]:
    """(key, seq, before, after, path, at, reason) of ``rows(key, seq, status, path, at)`` in order, from a status on."""
    for key, seq, wanted, path, at in rows:
        reason = "moved" if wanted in legal.get(status, ()) else "repeated" if wanted == status else "illegal" if wanted in legal else "unknown"
        yield key, seq, status, wanted, path, at, reason
        if reason == "moved":
            status = wanted


def moves(events: DataFrame, known: DataFrame, legal: dict = MIRROR) -> DataFrame:
    """Every event with the status before it and ``reason``: moved, repeated, illegal or unknown. ``events(key, seq, status, path, at)``, ``known(key, status)``.

    A key's events are read once in the order of ``seq`` from sorted rows, so a task holds no more than one batch of them.
    """
    start = known.select("key", F.lit(None).cast("long").alias("seq"), "status", F.lit(None).cast("string").alias("path"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("_kind"))
    rows = start.unionByName(events.select("key", "seq", "status", "path", "at").withColumn("_kind", F.lit(1)))
    ordered = rows.repartition("key").sortWithinPartitions("key", "_kind", "seq", "status")

    def walk(batches):
        own, status = None, None
        for pdf in batches:
            out = []
            for key, mine in groupby(zip(*(pdf[c].tolist() for c in ("key", "seq", "status", "path", "at", "_kind"))), key=lambda r: r[0]):
                mine = list(mine)
                status = status if key == own else None
                status = next((r[2] for r in mine if r[5] == 0), status)
                made = list(judged(status, ((r[0], int(r[1]), *r[2:5]) for r in mine if r[5]), legal))
                own, status = key, next((r[3] for r in reversed(made) if r[-1] == "moved"), status)
                out += made
            yield pd.DataFrame(out, columns=["key", "seq", "before", "after", "path", "at", "reason"]).astype({"at": "datetime64[us]"})

    return ordered.mapInPandas(walk, MOVE)


def moved_rows(table: DataFrame, judged_moves: DataFrame) -> DataFrame:
    """``table(key, status, path, at, ...)`` after the moves: of rows that moved only these three columns change; new keys have nulls elsewhere."""
    last = judged_moves.filter("reason = 'moved'").groupBy("key").agg(F.max_by(F.struct("after", "path", "at"), "seq").alias("m"))
    last = last.select("key", F.col("m.after").alias("_status"), F.col("m.path").alias("_path"), F.col("m.at").alias("_at"))
    both = table.join(last, "key", "full_outer")
    new = {c: F.when(F.col("_status").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("status", "path", "at")}
    return both.select(*[new.get(c, F.col(c)) for c in table.columns])


def reason_counts(judged_moves: DataFrame) -> DataFrame:
    return judged_moves.groupBy("reason").agg(F.count("*").alias("n"))


def sync_counts(rows: DataFrame, key: str, before: DataFrame) -> DataFrame:
    """One row: how many rows came, how many keys are new, and how many keys there are now."""
    keys = rows.select(key).distinct().withColumn("_new", F.lit(1))
    both = keys.join(before.select(key).distinct().withColumn("_old", F.lit(1)), key, "full_outer")
    totals = both.agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count("*").alias("total_items"))
    return rows.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")


def sync_reasons(rows: DataFrame) -> DataFrame:
    """``rows(path, exists, fields, written)`` with what became of each: ``outcome`` synced, skipped or failed, and ``reason``.

    The first that holds: no path below the root, no such file, nothing to write; then whether the write (null: not tried, an error) went well.
    """
    empty = F.col("fields").isNull() | (F.size(F.map_filter("fields", lambda k, v: F.size(v) > 0)) == 0)
    skipped = F.when(F.col("path").isNull(), "Not under music_repo").when(~F.coalesce("exists", F.lit(False)), "File not in repository").when(empty, "No metadata to sync")
    outcome = F.when(skipped.isNotNull(), "skipped").when(F.coalesce("written", F.lit(False)), "synced").otherwise("failed")
    return rows.withColumns({"outcome": outcome, "reason": F.coalesce(skipped, F.when(outcome == "failed", "Git-annex error"))})
