"""Repeated runs over files: what can be skipped, what is carried over, what is there, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Results that a repeated run keeps.
KEPT_STATUSES = ("ok", "warning")


def up_to_date(sources: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Sources with ``skip``: an output exists that isn't older. Both have ``mtime``; a null time is not up to date."""
    made = outputs.groupBy(key).agg(F.max("mtime").alias("_made"))
    skip = F.lit(False) if force else F.coalesce(F.col("mtime") <= F.col("_made"), F.lit(False))
    return sources.join(made, key, "left").withColumn("skip", skip).drop("_made")


def carried_over(files: DataFrame, before: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Results of an earlier run that stand (``ok`` or ``warning``) and the files still to be looked at."""
    kept = before.filter(F.col("status").isin(*KEPT_STATUSES)).join(files.select(key).distinct(), key, "left_semi")
    return kept, files.join(kept.select(key).distinct(), key, "left_anti")


def all_there(expected: DataFrame, existing: DataFrame, group: str, path: str) -> DataFrame:
    """``group`` and ``complete``: whether all its expected paths exist; groups without a path don't count."""
    here = existing.select(path).distinct().withColumn("_here", F.lit(True))
    return expected.join(here, path, "left").groupBy(group).agg(F.every(F.coalesce("_here", F.lit(False))).alias("complete"))


def first_of(rows: DataFrame, group: str, name: str, wanted: list[str]) -> DataFrame:
    """The row of each group whose ``name`` stands first in ``wanted``, the least name of equal ones (case counts not)."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.lower(F.col(name)))
    hits = rows.withColumn("_place", place).filter("_place > 0")
    return hits.groupBy(group).agg(F.min_by(name, F.struct("_place", F.col(name))).alias(name))


def first_seen(parts: list[DataFrame], key: str) -> DataFrame:
    """The keys of several listings one after the other, each once: ``key`` and ``part``, the first listing that has it."""
    out = parts[0].select(key, F.lit(0).alias("part"))
    for i, p in enumerate(parts[1:], 1):
        out = out.union(p.select(key, F.lit(i)))
    return out.groupBy(key).agg(F.min("part").alias("part"))


def tools_missing(files: DataFrame, tools: DataFrame, installed: DataFrame, extension: Column) -> DataFrame:
    """For each extension the number of files and the sorted tools it needs that aren't installed; ``tools(extension, tool)``."""
    need = tools.join(installed.select("tool").distinct(), "tool", "left_anti").groupBy("extension").agg(F.array_sort(F.collect_set("tool")).alias("missing"))
    counts = files.groupBy(extension.alias("extension")).agg(F.count("*").alias("files"))
    return counts.join(need, "extension", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def report_rows(releases: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Each release with its match's tier, ``none`` without one, and its score rounded half to even; ``matches`` has a row for a release at most."""
    rows = releases.join(matches.select(key, "tier", "score"), key, "left")
    return rows.withColumns({"tier": F.coalesce("tier", F.lit("none")), "score": F.bround("score")})


def names_of(rows: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """``key`` and ``names``: those that ``names(id, name)`` gives for the ids of a list, in the list's order; unknown ids are passed over."""
    each = rows.select(key, F.posexplode(ids).alias("_pos", "id")).join(names.select("id", "name"), "id")
    found = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "name"))).alias("_found"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce(F.col("_found.name"), F.array().cast("array<string>")).alias("names"))
