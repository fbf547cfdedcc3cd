"""What checking tools say about files: which tools a file needs, and whether a tool's run went well."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.text import extension


@dataclass(frozen=True)
class Group:
    extensions: tuple[str, ...]
    types: tuple[str, ...]
    tools: tuple[str, ...]


# Kinds of files by extension and MIME type, with the tools that check them, in order.
GROUPS = {
    "flac": Group((".flac",), ("audio/flac", "audio/x-flac"), ("flac",)),
    "mp3": Group((".mp3",), ("audio/mpeg", "audio/mp3"), ("mp3val", "ffmpeg")),
    "ogg": Group((".ogg", ".oga"), ("audio/ogg", "audio/x-vorbis+ogg", "audio/x-ogg"), ("ogginfo", "ffmpeg")),
    "wav": Group((".wav",), ("audio/wav", "audio/x-wav", "audio/wave"), ("shntool", "sox")),
    "aiff": Group((".aiff", ".aif"), ("audio/aiff", "audio/x-aiff"), ("sox",)),
    "m4a": Group((".m4a", ".aac"), ("audio/mp4", "audio/x-m4a", "audio/aac"), ("ffmpeg",)),
    "opus": Group((".opus",), ("audio/opus", "audio/ogg; codecs=opus"), ("ffmpeg",)),
    "wma": Group((".wma",), ("audio/x-ms-wma",), ("ffmpeg",)),
    "cue": Group((".cue",), ("application/x-cuesheet", "text/x-cue"), ()),
}
ANY_AUDIO, ANY_TOOLS = "audio", ("ffmpeg",)
MASK_TAG = "WAVEFORMATEXTENSIBLE_CHANNEL_MASK"
# What parts lines and what strip() removes.
LINE_BREAK, BLANK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", r"(?U)^[\s\x1c-\x1f]*$"


def _found(pairs: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def checker_group(file: Column, mime: Column) -> Column:
    """The kind of a file: by its extension, else by its MIME type, else any audio type's; null where nothing checks it."""
    by_extension = _found({x: name for name, g in GROUPS.items() for x in g.extensions}, F.lower(extension(file)))
    by_type = _found({x: name for name, g in GROUPS.items() for x in g.types}, mime)
    return F.coalesce(by_extension, by_type, F.when(mime.startswith("audio/"), ANY_AUDIO))


def tools_of(group: Column) -> Column:
    """The tools that check a kind of files; none for null."""
    out = F.when(group == ANY_AUDIO, F.array(*[F.lit(t) for t in ANY_TOOLS]))
    for name, g in GROUPS.items():
        out = out.when(group == name, F.array(*[F.lit(t) for t in g.tools]).cast("array<string>"))
    return F.coalesce(out, F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), LINE_BREAK)


def words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _reported(line: Column) -> Column:
    return line.startswith("WARNING") | line.startswith("PROBLEM")


def _flagged(line: Column) -> Column:
    """A row of a table whose fifth field names a problem; the table's head and rule are no rows."""
    flags = F.get(words(line), F.lit(4))
    head = F.lower(line).contains("problems") | (F.array_join(words(line), " ") == "---")
    return ~head & F.coalesce((flags != "-") & flags.rlike("[tijah]"), F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A run went well if its exit code is 0 (where that counts), the named stream is blank, and no line of stdout is bad; ``output`` are the streams that are shown."""

    output: tuple[str, ...]
    zero: bool = True
    blank: str | None = None
    bad: Callable[[Column], Column] | None = None


RULES = {
    "flac": Rule(("stderr",)),
    "mp3val": Rule(("stdout",), zero=False, bad=_reported),
    "ffmpeg": Rule(("stderr",), blank="stderr"),
    "shntool": Rule(("stdout",), bad=_flagged),
    "sox": Rule(("stderr",)),
    "ogginfo": Rule(("stdout", "stderr")),
}


def passed(rule: Rule, exit_code: str, streams: dict[str, str]) -> Column:
    out = (F.col(exit_code) == 0) if rule.zero else F.lit(True)
    if rule.blank:
        out = out & F.coalesce(F.col(streams[rule.blank]), F.lit("")).rlike(BLANK)
    if rule.bad:
        out = out & ~F.exists(lines(F.col(streams["stdout"])), rule.bad)
    return F.coalesce(out, F.lit(False))


def tool_results(runs: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """``runs(tool, exit_code, stdout, stderr)`` with ``success`` and ``output``; both are null for a tool without a rule. A null exit code is a failure."""
    streams = {"stdout": "stdout", "stderr": "stderr"}
    good, shown = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, rule in rules.items():
        here = F.col("tool") == name
        good = F.when(here, passed(rule, "exit_code", streams)).otherwise(good)
        shown = F.when(here, F.concat(*[F.coalesce(F.col(s), F.lit("")) for s in rule.output])).otherwise(shown)
    return runs.withColumns({"success": good, "output": shown})


def multichannel_warning(channels: Column, tag: Column) -> Column:
    """A warning about a stereo file that carries a channel mask; null without one. ``channels`` and ``tag`` are what the tools print."""
    clean = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    value = F.regexp_replace(clean(tag), r"(?s)^[^=]*=", "")
    text = F.concat(F.lit(f"Stereo file has {MASK_TAG}="), value, F.lit(". This causes playback issues on Pioneer players."))
    return F.when((clean(channels).try_cast("int") == 2) & (clean(tag) != ""), text)


def file_results(files: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``status`` of each of ``files(key, group)`` and its failed ``tools``, in order: ``skipped`` without a group, ``error`` if a tool failed, ``unchecked`` if none ran, else ``ok``."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("tool")))).alias("tools")
    ran = results.filter("success is not null").groupBy(key).agg(failed)
    status = F.when(F.col("group").isNull(), "skipped").when(F.col("tools").isNull(), "unchecked").when(F.size("tools") > 0, "error").otherwise("ok")
    return files.join(ran, key, "left").select(key, status.alias("status"), F.coalesce("tools", F.array().cast("array<string>")).alias("tools"))
