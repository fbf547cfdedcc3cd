"""Path templates such as ``{{ genre }}/{{ bpm | round_to(5) }}`` compiled to one column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.text import extension, path

_PART = re.compile(r"\{\{\s*(\w+)\s*((?:\|[^}]*)?)\}\}")
_FILTER = re.compile(r"\|\s*(\w+)\s*(?:\(([^)]*)\))?")


class TemplateError(ValueError):
    """The template can't be read."""


def round_to(c: Column, n: float) -> Column:
    """The nearest multiple of ``n``, ties to even; text that isn't a number counts as 0.0."""
    number = c.try_cast("double")
    if not n:
        return F.coalesce(number, F.lit(0.0)).cast("string")
    near = F.bround(number / n) * n
    return F.coalesce((near.cast("long") if float(n).is_integer() else near).cast("string"), F.lit("0.0"))


FILTERS = {
    "lower": lambda c, *a: F.lower(c.cast("string")),
    "upper": lambda c, *a: F.upper(c.cast("string")),
    "trim": lambda c, *a: F.trim(c.cast("string")),
    "truncate": lambda c, n: F.substring(c.cast("string"), 1, int(n)),
    "replace": lambda c, a, b: F.replace(c.cast("string"), F.lit(a), F.lit(b)),
    "default": lambda c, a: F.coalesce(c.cast("string"), F.lit(a)),
    "round_to": lambda c, n: round_to(c, float(n)),
}


def variables(template: str) -> set[str]:
    return {m[1] for m in _PART.finditer(template)}


def render(df: DataFrame, template: str) -> Column:
    """The template as a column; missing, null and empty values read ``Unknown``."""
    rest = _PART.sub("", template)
    if any(mark in rest for mark in ("{{", "}}", "{%", "%}", "{#", "#}")):
        raise TemplateError(f"can't read {template!r}")
    out, at = [], 0
    for m in _PART.finditer(template):
        if template[at : m.start()]:
            out.append(F.lit(template[at : m.start()]))
        text = F.nullif(F.col(m[1]).cast("string"), F.lit("")) if m[1] in df.columns else F.lit(None).cast("string")
        made = None
        for name, args in _FILTER.findall(m[2]):
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            values = [a.strip().strip("'\"") for a in args.split(",")] if args else []
            made = FILTERS[name](text if made is None else made, *values)
        out.append(F.coalesce(made if made is not None else text, F.lit("Unknown")))
        at = m.end()
    out.append(F.lit(template[at:]))
    return F.concat(*out)


def link_paths(df: DataFrame, template: str, file_col: str, order_col: str, present_col: str | None = None) -> DataFrame:
    """``target`` and a unique ``link_path`` for each row with a file: rendered, made safe, with the file's extension.

    Paths that collide get ``_1``, ``_2`` and so on, in ``order_col``'s order, before the extension; numbers that would give a path that another row
    has by itself are passed over.
    """
    rows = df.filter(F.col(file_col).isNotNull() & (F.col(present_col) if present_col else F.lit(True)))
    ext = extension(F.col(file_col))
    made = path(render(df, template))
    rows = rows.select("*", F.when(F.endswith(made, ext), F.substring(made, F.lit(1), F.length(made) - F.length(ext))).otherwise(made).alias("_base"), ext.alias("_ext"))
    n = F.row_number().over(Window.partitionBy("_base", "_ext").orderBy(order_col)) - 1
    rows = rows.select("_base", "_ext", n.cast("long").alias("_n"), F.col(order_col).alias("_order"), F.col(file_col).alias("_target"))
    # Of the numbers s1 < s2 < ... that are taken, si leaves si - i free ones below it; the n-th duplicate passes over those with less than n.
    number = F.regexp_extract("_base", r"^.*_([1-9]\d{0,17})$", 1).try_cast("long")
    taken = rows.select(F.regexp_extract("_base", r"^(.*)_[1-9]\d{0,17}$", 1).alias("_base"), "_ext", number.alias("_s")).filter("_s is not null").distinct()
    free = F.col("_s") - F.row_number().over(Window.partitionBy("_base", "_ext").orderBy("_s"))
    taken = taken.select("_base", "_ext", free.alias("_n"), F.lit(1).alias("_taken"))
    so_far = Window.partitionBy("_base", "_ext").orderBy("_n", "_taken").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_taken", F.lit(0)).unionByName(taken, allowMissingColumns=True)
    # At equal values duplicates come first, as numbers with n free ones below them don't count.
    both = both.withColumn("_k", F.col("_n") + F.coalesce(F.sum("_taken").over(so_far), F.lit(0))).filter("_taken = 0")
    name = F.concat(F.col("_base"), F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""), F.col("_ext"))
    return both.select(F.col("_order").alias(order_col), F.col("_target").alias("target"), name.alias("link_path"), (F.col("_n") > 0).alias("is_duplicate"))


def expanded(df: DataFrame, children: DataFrame, key: str, name: str, template: str) -> DataFrame:
    """A row for each child value, in column ``name``, if the template mentions it; rows without children stay as one row."""
    if name not in variables(template):
        return df
    return df.drop(name).join(children.select(key, name).distinct(), key, "left")


# What a strict path may not hold.
UNSAFE_STRICT = r'[<>:"|?*\x00-\x1f]'


def track_columns(df: DataFrame, file: str = "file") -> DataFrame:
    """The columns that templates know of tracks: those of the table, ``filename`` and ``ext`` made of its file, ``key`` from ``key_musical`` where that exists."""
    path = F.nullif(F.col(file), F.lit(""))
    name = F.regexp_extract(path, "([^/]*)$", 1)
    out = df.withColumns({"filename": F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""), "ext": F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)})
    return out.withColumn("key", F.col("key_musical")) if "key_musical" in df.columns else out


def strict_path(df: DataFrame, template: str, known: tuple[str, ...] = ("genre", "label", "artist", "album", "year")) -> tuple[Column, bool]:
    """A release's folder, and whether the template could be read: one that can't be, or that names something else than ``known``, gives ``artist - album`` or ``Unknown``.

    Null values read as empty ones. Unsafe characters go, as do blanks and dots at the ends of segments and segments that are then empty; a path without any is ``Unknown``.
    """
    full = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in known if c in df.columns])
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in full.columns else F.lit("") for c in known}
    readable = variables(template) <= set(known) and not any(mark in _PART.sub("", template) for mark in ("{{", "}}", "{%", "%}", "{#", "#}"))
    parts, at = [], 0
    for m in _PART.finditer(template) if readable else ():
        value = text[m[1]]
        for name, args in _FILTER.findall(m[2]):
            if name not in FILTERS:
                readable = False
                continue
            value = FILTERS[name](value, *([a.strip().strip("'\"") for a in args.split(",")] if args else []))
        parts += [F.lit(template[at : m.start()]), value]
        at = m.end()
    other = F.when((text["artist"] != "") & (text["album"] != ""), F.concat(text["artist"], F.lit(" - "), text["album"])).otherwise("Unknown")
    made = F.concat(*parts, F.lit(template[at:])) if readable else other
    segments = F.transform(F.split(made, "/"), lambda p: F.regexp_replace(F.regexp_replace(p, UNSAFE_STRICT, ""), r"^[ .]+|[ .]+$", ""))
    return F.coalesce(F.nullif(F.array_join(F.filter(segments, lambda p: p != ""), "/"), F.lit("")), F.lit("Unknown")), readable
