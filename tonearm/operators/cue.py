"""Cue sheets as tables: one row for each track, from the sheets' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.text import frames_to_samples

_COMMANDS = ("FILE", "TRACK", "TITLE", "PERFORMER", "SONGWRITER", "ISRC", "INDEX", "REM")
_REMARKS = ("GENRE", "DATE", "DISCID")


def cue_tracks(lines: DataFrame, key: str = "key", order: str = "line_no", text: str = "line", tasks: int | None = None) -> DataFrame:
    """Tracks of sheets given as lines: key, file, track_num, title, performer, songwriter, isrc, album, genre, date,
    disc_id, start_samples and end_samples (the next track's start in the same file).

    What stands before the first TRACK holds for the whole sheet; a TITLE there is the album. Only INDEX 01 counts;
    other commands are ignored. A line is parsed once, before the shuffle, and only lines that count are shuffled; that one shuffle by sheet serves
    all windows. What comes first is track 0 of its sheet. Sheets are dealt into ``tasks``, where given, so that what a task sorts doesn't grow with the lines.
    """
    line = F.trim(text)
    command = F.upper(F.regexp_extract(line, r"^(\w+)", 1)).alias("cmd")
    rest = F.trim(F.regexp_extract(line, r"^\w+\s+(.*)$", 1)).alias("arg")
    # An array of one holds both, so that filters on them don't parse the line again.
    rows = lines.select(key, order, F.inline(F.array(F.struct(command, rest)))).filter(F.col(key).isNotNull() & F.col("cmd").isin(*_COMMANDS))
    arg, is_ = F.col("arg"), lambda c: F.col("cmd") == c
    plain = lambda c: F.regexp_replace(c, r'^"(.*)"$', "$1")
    remark = lambda name: is_("REM") & F.upper("arg").startswith(name + " ")
    kind, value = F.when(~is_("REM") & (~is_("INDEX") | arg.rlike(r"^0?1\s")), F.col("cmd")), F.when(is_("TRACK"), F.regexp_extract("arg", r"^(\d+)", 1))
    value = value.when(is_("INDEX"), F.regexp_extract("arg", r"^\d+\s+(\S+)", 1)).when(is_("FILE"), F.regexp_replace("arg", r'^"(.*)"\s+\w+$|^(\S+)\s+\w+$', "$1$2"))
    for name in _REMARKS:
        kind, value = kind.when(remark(name), name), value.when(remark(name), plain(F.trim(F.substring("arg", len(name) + 2, 1 << 30))))
    rows = rows.select(key, order, kind.alias("kind"), value.otherwise(plain(arg)).alias("value")).filter("kind is not null")
    rows = rows.repartition(tasks, key) if tasks else rows
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = lambda c: F.max_by("value", F.when(F.col("kind") == c, F.col(order)))
    rows = rows.withColumns({
        "track": F.sum((F.col("kind") == "TRACK").cast("int")).over(so_far),
        "file": F.last(F.when(F.col("kind") == "FILE", F.col("value")), ignorenulls=True).over(so_far),
    })
    tracks = rows.groupBy(key, "track").agg(
        said("TRACK").try_cast("int").alias("track_num"), F.max_by("file", F.when(F.col("kind") == "TRACK", F.col(order))).alias("file"),
        *[said(c).alias(c.lower()) for c in ("TITLE", "PERFORMER", "SONGWRITER", "ISRC", "INDEX", *_REMARKS)])
    above = lambda c: F.first(F.when(F.col("track") == 0, F.col(c))).over(Window.partitionBy(key).orderBy("track").rowsBetween(Window.unboundedPreceding, 0))
    tracks = tracks.withColumns({"album": above("title"), "_performer": above("performer"), "_songwriter": above("songwriter"), "_genre": above("genre"), "_date": above("date"), "_disc": above("discid")}).filter("track > 0")
    end = F.lead("start_samples").over(Window.partitionBy(key, "file").orderBy("track"))
    out = tracks.withColumn("start_samples", frames_to_samples(F.coalesce("index", F.lit("")))).withColumn("end_samples", end)
    return out.select(key, "file", "track_num", "title", F.coalesce("performer", "_performer").alias("performer"), F.coalesce("songwriter", "_songwriter").alias("songwriter"), "isrc", "album", F.col("_genre").alias("genre"), F.col("_date").alias("date"), F.col("_disc").alias("disc_id"), "start_samples", "end_samples")
