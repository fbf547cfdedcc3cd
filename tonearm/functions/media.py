"""Functions on media attributes, formats and file names; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm.functions.text import one_line

# Download formats by alias, codecs that may be copied, and the longest text of each attribute.
FORMATS = {"flac": "flac", "mp3": "mp3-320", "mp3-320": "mp3-320", "mp3-v0": "mp3-v0", "mp3v0": "mp3-v0", "aac": "aac-hi", "aac-hi": "aac-hi", "alac": "alac", "wav": "wav", "ogg": "vorbis", "vorbis": "vorbis", "aiff": "aiff-lossless", "aiff-lossless": "aiff-lossless"}
COPYABLE = {"libmp3lame": ("mp3",), "flac": ("flac",), "pcm_s16be": ("pcm_s16be", "pcm_s24be"), "pcm_s16le": ("pcm_s16le", "pcm_s24le")}
LONGEST = {"key": 50, "artist": 500, "title": 500, "album": 500, "genre": 200, "year": 10, "tracknumber": 20, "comment": 2000}
RELEASE_TYPES = {"p": "P", "r": "R", "c": "C", "i": "I", "s": "S"}


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The table's value for each key, or the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def rating_text(c: Column) -> Column:
    return F.when(c != 0, c.cast("string"))


def bpm_text(c: Column) -> Column:
    return F.when(c > 0, F.format_string("%.2f", c.cast("double")))


def bpm_whole(c: Column) -> Column:
    return F.coalesce(F.bround(c).cast("long").cast("string"), F.lit(""))


def before_space(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, " ", 1), F.lit(""))


def attributes(columns: dict[str, Column]) -> Column:
    """A map of the attributes that have a value; texts are cleaned and cut to their longest."""
    made = {n: one_line(c.cast("string"), LONGEST[n]) if n in LONGEST else c.cast("string") for n, c in columns.items()}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.nullif(c, F.lit("")).alias("v")) for n, c in made.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def below(path: Column, root: str, other: str | None = None) -> Column:
    """The path relative to one of two roots; null outside."""
    cut = lambda r: F.when(F.startswith(path, F.lit(r.rstrip("/") + "/")), F.substring(path, len(r.rstrip("/")) + 2, 1 << 30))
    return F.coalesce(cut(root), cut(other)) if other else cut(root)


def under_any(path: Column, folders: list[str]) -> Column:
    """Whether the path is one of the given ones or lies below it; no paths: all."""
    return reduce(lambda a, b: a | b, [(path == f) | F.startswith(path, F.lit(f.rstrip("/") + "/")) for f in folders], F.lit(not folders))


def safe_name(c: Column, default: str = "") -> Column:
    """A file name: unsafe characters become one underscore, blanks and dots at the ends go."""
    c = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(c, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit(default))


def track_file(number: Column, title: Column) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Track "), number.cast("string")))
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit(" - "), safe_name(name), F.lit(".flac"))


def seconds_text(samples: Column) -> Column:
    return F.format_string("%.6f", samples / F.lit(44100.0))


def epoch_millis(c: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(c))


def url_decoded(c: Column) -> Column:
    """Percent escapes decoded; plus signs stay."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def archive_format(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".zip"), "zip").when(F.lower(name).endswith(".rar"), "rar")


def cover_side(name: Column, images_in_folder: Column) -> Column:
    """Front or back by name; the only image of a folder is the front."""
    low = F.lower(name)
    return F.when((images_in_folder == 1) | low.rlike("front|cover"), "front").when(low.rlike("back"), "back")


def may_copy(codec: Column, rate: Column, bits: Column, channels: Column, preset: dict) -> Column:
    """Whether a stream can be copied for a preset; what the preset leaves open (None) may be anything."""
    out = codec.isin(list(COPYABLE.get(preset["codec"], ())))
    for c, want in ((rate, preset.get("rate")), (bits, preset.get("bits")), (channels, preset.get("channels"))):
        if want is not None:
            out = out & (c == want)
    return F.coalesce(out, F.lit(False))


def export_action(present: Column, copyable: Column, add_cover: Column, post: Column) -> Column:
    return F.when(~present, "not_present").when(copyable & ~add_cover & ~post, "file_copied").when(copyable, "stream_copied").otherwise("encoded")


def check_status(present: Column, supported: Column, tools: Column, errors: Column, warnings: Column) -> Column:
    """The first status that holds: not_present, skipped, checker_missing, error, warning, ok."""
    return F.when(~present, "not_present").when(~supported, "skipped").when(~tools, "checker_missing").when(errors > 0, "error").when(warnings > 0, "warning").otherwise("ok")


def cue_problem(text: Column) -> Column:
    """Whether a cue sheet lacks a FILE or a TRACK line."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x))
    return ~(F.exists(lines, lambda x: F.startswith(x, F.lit("FILE "))) & F.exists(lines, lambda x: F.startswith(x, F.lit("TRACK "))))


# Presets as (codec, file extension, rate, bits, channels, carries covers), presets by extension, bits by sample format, store encodings by extension.
PRESETS = {
    "mp3-320": ("libmp3lame", ".mp3", None, None, None, True), "mp3-v0": ("libmp3lame", ".mp3", None, None, None, True),
    "flac": ("flac", ".flac", None, None, None, True), "flac-pioneer": ("flac", ".flac", 44100, 16, 2, True),
    "aiff": ("pcm_s16be", ".aiff", None, None, None, True), "aiff-pioneer": ("pcm_s16be", ".aiff", 44100, 16, 2, True),
    "wav": ("pcm_s16le", ".wav", None, None, None, False), "wav-pioneer": ("pcm_s16le", ".wav", 44100, 16, 2, False),
}
PRESET_OF_EXTENSION = {".mp3": "mp3-320", ".flac": "flac", ".aiff": "aiff", ".aif": "aiff", ".wav": "wav"}
SAMPLE_BITS = {"s16": 16, "s16p": 16, "s24": 24, "s32": 32, "s32p": 32, "flt": 32, "fltp": 32}
ENCODING_OF_EXTENSION = {".flac": "flac", ".mp3": "mp3-320", ".ogg": "vorbis", ".oga": "vorbis", ".m4a": "aac-hi", ".aac": "aac-hi", ".wav": "wav", ".aiff": "aiff-lossless", ".aif": "aiff-lossless"}
LOSSY, LOSSLESS = ("mp3", "aac", "vorbis", "opus", "wmav2"), ("flac", "pcm_s16be", "pcm_s16le", "pcm_s24be", "pcm_s24le")
AUDIO, ARTWORK, ARTWORK_NAMES = (".wav", ".mp3", ".flac", ".aif", ".aiff", ".ogg", ".opus"), (".jpg", ".jpeg", ".png"), ("cover", "front", "folder", "artwork")
SHEET_TAGS = {"performer": "ARTIST", "album": "ALBUM", "title": "TITLE", "track_num": "TRACKNUMBER", "genre": "GENRE", "date": "DATE", "songwriter": "SONGWRITER", "isrc": "ISRC", "disc_id": "DISCID"}


def bit_depth(raw_bits: Column, sample_format: Column) -> Column:
    """The bits that a probe tells, else those of the sample format, else 16."""
    known = lookup(sample_format, {k: str(v) for k, v in SAMPLE_BITS.items()}).cast("int")
    return F.coalesce(F.when(raw_bits.try_cast("int") > 0, raw_bits.try_cast("int")), known, F.lit(16))


def preset_name(wanted: Column, template: Column) -> Column:
    """(preset, error): the preset asked for, else the one of the template's extension."""
    last = F.trim(F.element_at(F.split(F.replace(template, F.lit("}}"), F.lit("/")), "/"), -1))
    ext = F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(last, ".", -1)))).otherwise("")
    asked, found = F.nullif(wanted, F.lit("")), lookup(ext, PRESET_OF_EXTENSION)
    known = asked.isin(*PRESETS)
    error = F.when(known | (asked.isNull() & found.isNotNull()), None).when(asked.isNotNull(), F.concat(F.lit("Invalid format preset: "), asked)).when(ext == "", "No file extension in the template").otherwise(F.concat(F.lit("Unrecognized extension: "), ext))
    return F.struct(F.when(known, asked).when(asked.isNull(), found).alias("preset"), error.alias("error"))


def preset_value(preset: Column, place: int) -> Column:
    return lookup(preset, {k: str(v[place]) for k, v in PRESETS.items() if v[place] is not None})


def convert_decision(codec: Column, rate: Column, bits: Column, channels: Column, preset: Column) -> Column:
    """(preset, stream_copy, codec) of a file to be made: lossy sources aren't turned into lossless files, equal ones are copied, others encoded with the source's bits.

    A lossy source that has no preset of its own is copied into the preset's container.
    """
    target = preset_value(preset, 0)
    kept = codec.isin(*LOSSY) & target.isin(*LOSSLESS)
    same = F.lit(False)
    for name, p in PRESETS.items():
        same = F.when(preset == name, may_copy(codec, rate, bits, channels, {"codec": p[0], "rate": p[2], "bits": p[3], "channels": p[4]})).otherwise(same)
    copy = F.coalesce(kept | same, F.lit(False))
    own = F.when(F.coalesce(kept, F.lit(False)) & (codec == "mp3"), "mp3-320").otherwise(preset)
    open_bits = preset_value(preset, 3).isNull()
    made = F.when(open_bits & (target == "pcm_s16be"), F.format_string("pcm_s%dbe", bits)).when(open_bits & (target == "pcm_s16le"), F.format_string("pcm_s%dle", bits)).otherwise(target)
    return F.struct(own.alias("preset"), copy.alias("stream_copy"), F.when(copy, "copy").otherwise(made).alias("codec"))


def display_path(files: Column, album: Column) -> Column:
    """(path, album) for a listing: the file itself and a mark where a match has two files at most, else their folder."""
    few, first = F.size(files) <= 2, F.get(files, F.lit(0))
    path = F.when(F.size(files) == 0, "").when(few, first).otherwise(F.regexp_extract(first, "^(.*)/[^/]*$", 1))
    return F.struct(F.coalesce(path, F.lit("")).alias("path"), F.when(few, F.concat(F.lit("[t] "), album)).otherwise(album).alias("album"))


def tag_arguments(columns: dict[str, Column]) -> Column:
    """A tagging tool's arguments, two for each value that isn't null or empty, in the order of ``SHEET_TAGS``."""
    pairs = [F.when(columns[c].cast("string") != "", F.array(F.lit(f"--remove-tag={t}"), F.concat(F.lit(f"--set-tag={t}="), columns[c].cast("string")))) for c, t in SHEET_TAGS.items() if c in columns]
    return F.flatten(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def preferred_source(links: Column, wanted: str) -> Column:
    """The link of the wanted source, else the first of ``links(source, url)``; null where that is empty."""
    hit = F.filter(links, lambda x: (x["source"] == wanted) & x["url"].isNotNull())
    return F.nullif(F.coalesce(F.get(hit, F.lit(0))["url"], F.get(links, F.lit(0))["url"]), F.lit(""))


def contains_either(a: Column, b: Column, needle: str) -> Column:
    """Whether one of two columns holds the text, whatever the case; no character is special."""
    return F.coalesce(F.contains(F.lower(a), F.lit(needle.lower())), F.lit(False)) | F.coalesce(F.contains(F.lower(b), F.lit(needle.lower())), F.lit(False))


def file_kind(path: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a path is a file of one of the extensions that isn't hidden."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return ~name.startswith(".") & F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).isin(*kinds)


def artwork_rank(path: Column) -> Column:
    """0 for the names that covers usually have, else 1."""
    return F.when(F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)).isin(*ARTWORK_NAMES), 0).otherwise(1)


def store_encoding(path: Column, wanted: str | None = None) -> Column:
    """The store's name of a file's format; flac for any other extension."""
    return F.lit(wanted) if wanted else lookup(F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)), ENCODING_OF_EXTENSION, "flac")


def resolved_format(wanted: Column, available: Column) -> Column:
    """(encoding, error) of a format asked for by one of its names, if it is among those offered."""
    found = lookup(F.lower(wanted), FORMATS)
    offered = F.array_join(F.array_sort(available), ", ")
    there = F.coalesce(F.array_contains(available, found), F.lit(False))
    error = F.when(found.isNull(), F.concat(F.lit("Unknown format: "), wanted)).when(~there, F.concat(F.lit("Format '"), wanted, F.lit("' is not available; have: "), offered))
    return F.struct(F.when(there, found).alias("encoding"), error.alias("error"))


def download_links(downloads: Column) -> Column:
    """Encoding to URL of a JSON text's entries that are objects with a ``url``."""
    entries = F.from_json(downloads, "map<string,string>")
    links = F.transform_values(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, v: F.get_json_object(v, "$.url"))
    return F.map_filter(links, lambda k, v: v.isNotNull())


def year_of(date: Column) -> Column:
    return F.coalesce(F.substring(date, 1, 4), F.lit(""))
