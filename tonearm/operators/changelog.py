"""Change-logs replayed into current attributes, and refreshes of tables made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.text import decoded


def operations(lines: DataFrame) -> DataFrame:
    """(key, line_no, pos, field, op, value) of log lines such as ``1700s artist +A -B genre +C``.

    A bare token names the field of the changes after it; changes before any field are dropped. Fields that
    are only named have a row with a null op.
    """
    body = F.regexp_replace("line", r"^\s*\d+(?:\.\d+)?s\s*", "")
    parts = lines.select("key", "line_no", F.posexplode(F.filter(F.split(F.trim(body), r"\s+"), lambda t: t != "")).alias("pos", "token"))
    change = F.col("token").rlike("^[+-].")
    line = Window.partitionBy("key", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = parts.withColumn("field", F.last(F.when(~change, F.col("token")), ignorenulls=True).over(line))
    op, value = F.when(change, F.substring("token", 1, 1)), F.when(change, decoded(F.substring("token", 2, 1 << 30)))
    return named.filter("field is not null").select("key", "line_no", "pos", "field", op.alias("op"), value.alias("value"))


def current_values(ops: DataFrame) -> DataFrame:
    """(key, field, value) that stand after the last operation on each value; one partial aggregation, one shuffle."""
    last = ops.filter("op is not null").groupBy("key", "field", "value").agg(F.max_by("op", F.struct("line_no", "pos")).alias("op"))
    return last.filter("op = '+'").select("key", "field", "value")


def wide(values: DataFrame, fields: list[str], casts: dict[str, str] | None = None) -> DataFrame:
    """A row for each key with the least value of each field; values that don't cast are null."""
    out = values.groupBy("key").pivot("field", fields).agg(F.min("value"))
    return out.select("key", *[F.col(f).try_cast((casts or {}).get(f, "string")).alias(f) for f in fields])


def changed_keys(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """``key`` and ``change`` (added, removed, changed) between two snapshots."""
    a, b = old.select(key, F.col(version).alias("_old")), new.select(key, F.col(version).alias("_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).filter("change is not null")


def replace_keys(base: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The table with all rows of changed keys replaced by the fresh ones; keys without any are gone."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert(base: DataFrame, incoming: DataFrame, key: str, keep_if_empty: list[str]) -> DataFrame:
    """Insert or update by key; listed columns keep their old value when the new one is null or empty."""
    old = base.select(key, *[F.col(c).alias(f"_{c}") for c in base.columns if c != key])
    both = old.join(incoming, key, "full_outer")
    here = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in incoming.columns if c != key])

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"_{c}")
        new = F.nullif(F.col(c), F.lit("")) if dict(incoming.dtypes)[c] == "string" and c in keep_if_empty else F.col(c)
        return F.coalesce(new, F.col(f"_{c}")) if c in keep_if_empty else F.when(here, F.col(c)).otherwise(F.col(f"_{c}"))

    return both.select(key, *[merged(c).alias(c) for c in base.columns if c != key])


def newer_than(df: DataFrame, col: str, since) -> DataFrame:
    """Rows changed after a watermark, or never stamped; without a watermark all rows."""
    return df if since is None else df.filter((F.col(col) > F.lit(since)) | F.col(col).isNull())


def until_known(page: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a newest-first listing before the first one whose key is known."""
    first = page.join(known.select(key).distinct(), key, "left_semi").agg(F.min(order).alias("_stop"))
    return page.join(F.broadcast(first), F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def build_tables(lines: DataFrame, files: DataFrame, present: DataFrame, fields: list[str], child: str, casts: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The current table and its child rows, built from all log lines.

    The table has a row for each key with its ``file`` and whether it is ``present``: it has a file and its key is among ``present``. Child rows
    are the values of the field ``child`` that aren't empty.
    """
    values = current_values(operations(lines))
    here = present.select("key").distinct().withColumn("_here", F.lit(True))
    rows = wide(values, fields, casts).join(files.select("key", "file"), "key", "left").join(here, "key", "left")
    rows = rows.withColumn("present", F.col("file").isNotNull() & F.coalesce("_here", F.lit(False))).drop("_here")
    return rows, values.filter((F.col("field") == child) & (F.col("value") != "")).select("key", F.col("value").alias(child))


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str, title: str) -> DataFrame:
    """The child table in which the rows of ``parents(key)`` are ``fresh``, of which those without a title are left out."""
    return replace_keys(children, fresh.filter(F.coalesce(F.col(title), F.lit("")) != "").join(parents.select(key).distinct(), key, "left_semi").select(children.columns), parents, key)
