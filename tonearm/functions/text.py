"""Text functions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and characters that clean-up rules look for.
EDITION = r"(?i)\s*[\(\[](deluxe|remaster(?:ed)?|bonus\s+track(?:\s+version)?|expanded|anniversary|special|limited|collector'?s?|super\s+deluxe|\d+(?:st|nd|rd|th)\s+anniversary)(?:\s+edition)?[\)\]]"
NOISE = r"(?iU)\b(free\s+download|single|original\s+mix)\b"
VOLUME = r"(?i)(?:vol(?:ume)?|part|pt)\.?\s*(\d+|[IVXLC]+)"
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10, "XI": 11, "XII": 12}
TIERS = ((95, "exact"), (80, "high"), (60, "low"))
UNSAFE_IN_PATHS = '<>:"|?*\x00'


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"(?U)\s+", " ")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def strip_edition(c: Column) -> Column:
    """Without a bracketed remark about the edition."""
    return F.regexp_replace(c, EDITION, "")


def normalize_for_matching(c: Column) -> Column:
    """Clean-up before names are compared; catalogue numbers in square brackets go before edition remarks do."""
    c = F.regexp_replace(c, "[​‌‍﻿]", "")
    c = F.regexp_replace(c, "[«»“”„]", "")
    c = F.regexp_replace(c, r"(?U)\[\w+\]", "")
    c = F.regexp_replace(c, NOISE, "")
    c = F.regexp_replace(c, r"[\u2010-\u2015\-_:]", " ")
    c = strip_punctuation(normalize(strip_edition(c)))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def volume(c: Column) -> Column:
    """The first volume or part number, arabic or roman up to twelve."""
    token = F.regexp_extract(c, VOLUME, 1)
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    return F.coalesce(token.try_cast("int"), F.try_element_at(roman, F.upper(token)))


def embedded_artist(title: Column) -> Column:
    """(artist, rest) of a title parted by spaced dashes; no dash: (null, title)."""
    parts = F.filter(F.transform(F.split(title, r"\s+[-–—]\s+"), lambda x: F.trim(x)), lambda x: x != "")
    two = F.size(parts) >= 2
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " - ")
    return F.struct(F.when(two, F.get(parts, F.lit(0))).alias("artist"), F.when(two, rest).otherwise(title).alias("title"))


def tier(score: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def subdomains(text: Column, domain: str) -> Column:
    """The lower-case sub-domains of every link to ``domain``, one for each link."""
    host = domain.replace(".", r"\.")
    return F.transform(F.regexp_extract_all(text, F.lit(rf"https?://([\w-]+)\.{host}"), F.lit(1)), F.lower)


def clip(c: Column, width: int) -> Column:
    """Cut to ``width`` characters, the last of them an ellipsis where there is room."""
    if not width:
        return c
    return F.when(F.length(c) <= width, c).otherwise(F.substring(c, 1, width) if width <= 1 else F.concat(F.substring(c, 1, width - 1), F.lit("…")))


def path_segment(c: Column) -> Column:
    """Safe as a file's name: at most 255 bytes of UTF-8, cut between characters."""
    c = F.translate(c, UNSAFE_IN_PATHS, "-" * len(UNSAFE_IN_PATHS))
    c = F.regexp_replace(F.trim(c), r"^\.+|\.+$", "")
    head = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, 255).cast("string"))
    c = F.when(F.octet_length(c) > 255, F.regexp_replace(head, "\ufffd+$", "")).otherwise(c)
    return F.when(c == "", "Unknown").otherwise(c)


def path(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, "/"), lambda x: x != ""), path_segment), "/")


def one_line(c: Column, most: int = 1000) -> Column:
    c = F.regexp_replace(F.translate(c, "\n\r\t", "   "), r"[\x00-\x1f\x7f]", "")
    c = F.trim(F.regexp_replace(c, " +", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def decoded(c: Column) -> Column:
    """Values that start with ``!`` are base64; bytes that aren't UTF-8 become replacement characters."""
    return F.when(F.startswith(c, F.lit("!")), F.make_valid_utf8(F.unbase64(F.substring(c, 2, 1 << 30)).cast("string"))).otherwise(c)


def color_hex(c: Column) -> Column:
    return F.format_string("#%06X", c)


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters and digits without accents, for phrase search."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")


def frames_to_samples(c: Column) -> Column:
    """``mm:ss:ff`` as samples at 44.1 kHz (75 frames a second); anything else is 0."""
    p = F.split(c, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return F.when(F.size(p) == 3, F.coalesce((n(1) * 60 + n(2)) * 44100 + n(3) * 588, F.lit(0))).otherwise(F.lit(0)).cast("long")
