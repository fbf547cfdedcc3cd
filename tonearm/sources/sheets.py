"""Cue sheets and the audio files beside them: bytes read with a ladder of encodings, and names without their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.text import extension, folder

# The Windows code page's characters between 80 and 9F, and the five bytes that it leaves open; formats that can be cut.
CP1252 = dict(zip((0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F), "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"))
OPEN_BYTES = ("81", "8D", "8F", "90", "9D")
CUTTABLE = (".flac", ".wav", ".ape", ".wv")


def decoded_bytes(content: Column, encoding: str | None = None) -> Column:
    """Text of bytes in the first encoding that fits them all: UTF-8, Windows-1252, Latin-1; or in the one given, null where it doesn't fit."""
    utf8 = content.cast("string")
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(chr(b) for b in CP1252), "".join(CP1252.values()))
    fits = {"utf-8": F.is_valid_utf8(utf8), "cp1252": ~F.hex(content).rlike(f"^(?:..)*?(?:{'|'.join(OPEN_BYTES)})"), "latin-1": F.lit(True)}
    text = {"utf-8": utf8, "cp1252": windows, "latin-1": latin}
    out = F.lit(None).cast("string")
    for name in reversed([encoding] if encoding else list(text)):
        out = F.when(fits[name], text[name]).otherwise(out)
    return out


def sheet_lines(sheets: DataFrame, encoding: str | None = None) -> DataFrame:
    """(key, line_no, line) of ``sheets(path, content)``; sheets that the given encoding doesn't fit have one row with a null line."""
    text = sheets.select(F.col("path").alias("key"), decoded_bytes(F.col("content"), encoding).alias("text"))
    return text.select("key", F.posexplode_outer(F.split("text", r"\r\n|[\n\r]")).alias("line_no", "line"))


def sheet_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of cue sheets below a pattern."""
    return spark.read.format("binaryFile").load(glob).filter(F.lower("path").endswith(".cue")).select("path", "content")


def file_names(spark: SparkSession, glob: str) -> DataFrame:
    """(path, stamp) of all files below a pattern; their content isn't read. ``stamp`` tells when a file has changed."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", F.concat_ws("-", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")).alias("stamp"))


def tracks_by_file(tracks: DataFrame, sheets: DataFrame | None = None, key: str = "key") -> DataFrame:
    """(key, file, place, tracks): the tracks' numbers for each file of a sheet, files by their first track; a track without a file belongs to the sheet's own, or to ``''``."""
    rows = tracks.withColumn("_file", F.nullif("file", F.lit("")))
    if sheets is not None:
        rows = rows.join(sheets.select(key, F.nullif("file", F.lit("")).alias("_own")), key, "left").withColumn("_file", F.coalesce("_file", "_own")).drop("_own")
    return rows.groupBy(key, F.coalesce("_file", F.lit("")).alias("file")).agg(F.min("track_num").alias("place"), F.array_sort(F.collect_list("track_num")).alias("tracks"))


def cue_pairs(files: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    """(key, audio, missing, unsupported): each sheet's first file that is there in a format that can be cut, and the names of those that aren't.

    ``files(key, file, place)`` are the files that a sheet names, ``names(path)`` what exists; a file stands in the sheet's folder. Sheets that name no file have no row;
    those with none that can be cut have a null ``audio``.
    """
    asked = files.filter("file <> ''").withColumn("path", F.concat(F.when(folder(F.col(key)) == "", F.lit("")).otherwise(F.concat(folder(F.col(key)), F.lit("/"))), F.col("file")))
    here = asked.join(names.select("path").distinct().withColumn("_here", F.lit(True)), "path", "left")
    fits = F.lower(extension(F.col("file"))).isin(*CUTTABLE)
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("file"))))
    return here.groupBy(key).agg(
        F.min_by("path", F.when(F.col("_here") & fits, F.struct("place", "file"))).alias("_first"), F.max(F.coalesce(F.col("_here") & fits, F.lit(False))).alias("_any"),
        listed(F.col("_here").isNull()).alias("missing"), listed(F.col("_here") & ~fits).alias("unsupported"),
    ).select(key, F.when(F.col("_any"), F.col("_first")).alias("audio"), "missing", "unsupported")
