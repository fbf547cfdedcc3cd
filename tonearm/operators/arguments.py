"""What a command's arguments stand for: files, folders and search terms in one listing, in the arguments' order."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(args: list[str], cwd: str, root: str) -> list[tuple[int, int, str | None]]:
    """(rank, attempt, path below ``root``) of what each argument may name: from the current folder, from the root, as it is; None is outside."""
    out = []
    for rank, arg in enumerate(args):
        for attempt, base in enumerate((cwd, root, "/")):
            if attempt == 2 and not arg.startswith("/"):
                continue
            path = posixpath.normpath(posixpath.join(base, arg))
            inside = path == root or path.startswith(root.rstrip("/") + "/")
            out.append((rank, attempt, posixpath.relpath(path, root) if inside else None))
    return out


def ancestors(file: Column) -> Column:
    """A path and all folders above it, up to ``.``."""
    parts = F.split(file, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def resolve(inventory: DataFrame, args: list[str], find: Callable[[str], DataFrame], cwd: str, root: str, present_only: bool = True) -> DataFrame:
    """``file``, ``rank`` and ``present``: the files that the arguments name or find, each once, where it comes first.

    ``inventory(file, present)`` lists files below ``root``. An argument that names a file or folder of it, tried from the current folder, from the root and as an
    absolute path, gives that file or all files below it; the others are one search string, in their order, which ``find`` turns into rows with a ``file``, and
    whose hits come last, as rank ``len(args)``. Files outside the root, null ones and those that the inventory doesn't list are left out of hits. Without arguments all files are named.
    Containment is a join of each file's folders with the few names that the arguments may stand for; only which argument is a path comes to the driver.
    """
    files = inventory.filter("file is not null").select("file", F.coalesce("present", F.lit(False)).alias("present"))
    if not args:
        named = files.withColumn("rank", F.lit(0))
    else:
        tried = candidates(args, cwd, root)
        # At most three rows for each argument.
        names = files.sparkSession.createDataFrame([t for t in tried if t[2] is not None], "rank int, attempt int, path string")
        below = files.select("file", "present", F.explode(ancestors(F.col("file"))).alias("path")).join(F.broadcast(names), "path")
        chosen = {r["rank"]: r["attempt"] for r in below.groupBy("rank").agg(F.min("attempt").alias("attempt")).collect()}
        named = below.join(F.broadcast(files.sparkSession.createDataFrame(list(chosen.items()), "rank int, attempt int")), ["rank", "attempt"]).select("file", "present", "rank")
        terms = [a for rank, a in enumerate(args) if rank not in chosen]
        if terms:
            hits = find(" ".join(terms)).select("file").distinct()
            named = named.union(files.join(hits, "file", "left_semi").select("file", "present", F.lit(len(args)).alias("rank")))
    first = named.groupBy("file").agg(F.min("rank").alias("rank"), F.max("present").alias("present"))
    return first.filter("present") if present_only else first


def common_folder(df: DataFrame, path: str) -> DataFrame:
    """One row with ``folder``, what is cut from all paths: the folder above all that the paths have in common; null for one path or none.

    The least and the greatest path by their segments have in common what all have, and both combine before the shuffle.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    ends = df.filter(F.col(path) != "").agg(F.min(parts).alias("a"), F.max(parts).alias("b"), F.count("*").alias("n"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int"), F.size(same) + 1) - 1
    return ends.select(F.when((F.col("n") > 1) & (shared > 1), F.array_join(F.slice("a", F.lit(1), shared - 1), "/")).alias("folder"))


def strip_common_folder(df: DataFrame, path: str) -> DataFrame:
    """``path`` without the folder that all of them share, as :func:`common_folder` tells; empty paths and null ones are empty, one path stays whole."""
    cut = common_folder(df, path)
    rest = F.when(F.col("_cut").isNull(), F.coalesce(F.col(path), F.lit(""))).when(F.coalesce(F.col(path), F.lit("")) == "", "").otherwise(F.substring(F.col(path), F.length("_cut") + 2, F.length(path)))
    folder = F.broadcast(cut.select(F.col("folder").alias("_cut"), F.lit(1).alias("_one")))
    return df.withColumn("_one", F.lit(1)).join(folder, "_one", "left").withColumn(path, rest).drop("_cut", "_one")


def clean_segments(path: Column) -> Column:
    """A path's segments without empty ones and ``.``; ``..`` takes the one before it away, where there is one."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(done, p):
        back = (p == "..") & (F.size(done) > 0) & (F.element_at(done, F.when(F.size(done) > 0, -1).otherwise(F.lit(None).cast("int"))) != "..")
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, none, step)


def relative_target(target: Column, link: Column) -> Column:
    """``target`` as seen from the folder of ``link``: up to what both share, then down; both start from the same folder.

    Null where the link lies above that folder, whose name isn't known.
    """
    a, b = clean_segments(target), clean_segments(F.regexp_extract(link, r"^(.*?)/?[^/]*$", 1))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int"), F.size(same) + 1) - 1
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0))))
    known = ~F.array_contains(F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0))), "..")
    return F.when(target.isNotNull() & link.isNotNull() & known, F.when(F.size(steps) == 0, ".").otherwise(F.array_join(steps, "/")))
