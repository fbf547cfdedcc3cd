"""Structure read from release posts and store pages: titles, links, covers, tracklists, credits, categories, discographies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.functions.media import url_decoded

# Patterns of credit lines, labels, speeds and numbered lines; categories that are genres.
CREDITS = r"(?i)(?:written\s+(?:and\s+)?produced\s+by|produced\s+by|master(?:ed|ing)?\s+(?:by|at)|(?:artwork|art|cover\s+art)\s+(?:by|–)|released\s+by|compiled\s+by|mix(?:ed)?\s+by|design\s+by|letters?\s+by|logo\s+by)[:\s]+.+"
RELEASED_BY = r"(?i)released\s+(?:by|on)[:\s]+(.+)"
LABEL_IN_TITLE = r"(?i)\s*\([^)]*(?:records?|label|audio)\s*[^)]*\)\s*$"
SPEED = r"(?i)[\[\(]\s*(\d{2,3}(?:\s*[-–]\s*\d{2,3})*)\s*bpms?\s*[\]\)]"
NUMBERED = r"^(\d{1,2})\s*[.\-–—)]+\s*(.+)$"
IGNORED_IDS = (1, 3, 6, 42)
GENRE_IDS = (7, 8, 9, 10, 11, 12, 14, 15, 16, 28, 29, 30, 33, 44, 47, 48, 69)
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&"}


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is named: an array of one holds it."""
    return F.transform(F.array(c), use)[0]


def unescaped(c: Column) -> Column:
    """Named references of ``ENTITIES``, and all decimal and hexadecimal ones, decoded."""
    parts = F.split(c, r"(?<=;)|(?=&#)")
    code = lambda p: F.coalesce(F.regexp_extract(p, r"^&#(\d+);$", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).try_cast("int"))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&#"), once(code(p), lambda n: F.when(n.isNotNull(), char(n)).otherwise(p))).otherwise(p)), "")
    for name, char_ in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char_))
    return out


def parse_title(c: Column) -> Column:
    """(artist, album) of a post's title: cut at the first en dash, em dash or spaced hyphen that has text on both sides."""
    return once(F.trim(F.regexp_replace(unescaped(c), LABEL_IN_TITLE, "")), _cut_title)


def _cut_title(t: Column) -> Column:
    various = t.rlike(r"(?i)^v/?a\b")
    rest = F.trim(F.regexp_replace(t, r"(?i)^v/?a\b\s*[-–—:]?\s*", ""))
    out = F.struct(F.lit("Various Artists").alias("artist"), t.alias("album"))
    for dash in (" - ", "—", "–"):
        at = F.instr(t, dash)
        left, right = F.trim(F.substring_index(t, dash, 1)), F.trim(F.substring(t, at + F.lit(len(dash)), F.lit(1 << 30)))
        out = F.when((at > 0) & (left != "") & (right != ""), F.struct(left.alias("artist"), right.alias("album"))).otherwise(out)
    return F.when(various, F.struct(F.lit("Various Artists").alias("artist"), rest.alias("album"))).otherwise(out)


def text_lines(html: Column) -> Column:
    """The texts between a page's tags, one line each, without blanks at the ends."""
    return F.filter(F.transform(F.split(unescaped(F.regexp_replace(html, "<[^>]*>", "\n")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def download_urls(html: Column, domain: str) -> Column:
    """Archive links by kind: the last wav, the last mp3, else the first other one as download."""
    links = F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href\s*=\s*["\']([^"\']+)["\']'), F.lit(1)), unescaped)
    low = lambda u: F.lower(url_decoded(u))
    own = F.filter(links, lambda u: F.contains(u, F.lit(domain)) & low(u).rlike(r"\.(?:zip|rar)$"))
    kind = lambda u: F.when(F.contains(low(u), F.lit("wav")), "wav").when(F.contains(low(u), F.lit("mp3")), "mp3").otherwise("download")
    # Each own link with its kind, which is told once.
    kinds = F.transform(own, lambda u: F.struct(kind(u).alias("k"), u.alias("v")))
    pick = lambda all_, k, last: F.try_element_at(F.filter(all_, lambda u: u["k"] == k), F.lit(-1 if last else 1))
    picked = once(kinds, lambda all_: F.array(*[pick(all_, k, k != "download") for k in ("wav", "mp3", "download")]))
    return F.map_from_entries(F.filter(picked, lambda p: p.isNotNull()))


def cover_url(html: Column, fallback: Column) -> Column:
    """The first image's widest source, else its plain source, else the fallback."""
    image = F.regexp_extract(html, r"(?i)(<img\s[^>]*>)", 1)
    entries = F.split(F.regexp_extract(image, r'(?i)srcset\s*=\s*["\']([^"\']+)["\']', 1), r"\s*,\s+")
    sized = F.filter(F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r"\s(\d+)w\s*$", 1).try_cast("int").alias("w"), F.regexp_extract(F.trim(e), r"^(\S+)", 1).alias("u"))), lambda e: e["w"].isNotNull())
    widest = F.aggregate(sized, F.struct(F.lit(0).alias("w"), F.lit(None).cast("string").alias("u")), lambda a, e: F.when(e["w"] > a["w"], e).otherwise(a))["u"]
    return F.coalesce(widest, F.nullif(F.regexp_extract(image, r'(?i)\ssrc\s*=\s*["\']([^"\']+)["\']', 1), F.lit("")), fallback)


def tracklist(html: Column) -> Column:
    """Numbered lines as (number, title, artist, bpm)."""
    def one(line):
        rest = F.trim(F.regexp_extract(line, NUMBERED, 2))
        bare = F.trim(F.regexp_replace(rest, SPEED + ".*$", ""))
        title, artist = F.regexp_extract(bare, r"^(.+?)\s*[-–—]\s+(.+)$", 1), F.regexp_extract(bare, r"^(.+?)\s*[-–—]\s+(.+)$", 2)
        name = F.regexp_replace(F.when(artist != "", title).otherwise(bare), r"[ \-–—.,;:]+$", "")
        return F.struct(F.regexp_extract(line, NUMBERED, 1).try_cast("int").alias("number"), name.alias("title"), F.nullif(F.trim(artist), F.lit("")).alias("artist"), F.nullif(F.regexp_extract(rest, SPEED, 1), F.lit("")).alias("bpm"))

    return F.filter(F.transform(F.filter(text_lines(html), lambda x: x.rlike(NUMBERED)), one), lambda t: t["title"] != "")


def credit_text(html: Column) -> Column:
    return once(F.array_join(F.filter(text_lines(html), lambda x: x.rlike(CREDITS)), "; "), lambda x: F.nullif(x, F.lit("")))


def label_name(html: Column) -> Column:
    """The name after the first "released by" or "released on", cut at the first of " & ", " and " and ", " that it holds, in this order."""
    found = F.regexp_replace(F.trim(F.regexp_extract(F.array_join(text_lines(html), "\n"), RELEASED_BY, 1)), "[.,;:]+$", "")

    def cut(name: Column) -> Column:
        out = name
        for mark in (", ", " and ", " & "):
            at = F.instr(F.lower(name), mark)
            out = F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(out)
        return F.nullif(out, F.lit(""))

    return once(found, cut)


def category_kind(c: Column, ignored: tuple[int, ...] = IGNORED_IDS, genres: tuple[int, ...] = GENRE_IDS) -> Column:
    return F.when(c.isin(*ignored) if ignored else F.lit(False), "ignored").when(c.isin(*genres), "genre").otherwise("label")


def primary(values: Column, *fallbacks: Column) -> Column:
    """The first of a list, else the first fallback that has a value."""
    return F.coalesce(F.get(values, F.lit(0)), *fallbacks)


def release_content(posts: DataFrame, html: str, title: str, domain: str, media: str) -> DataFrame:
    h = F.col(html)
    made = {"downloads": download_urls(h, domain), "cover_art_url": cover_url(h, F.col(media)), "tracklist": tracklist(h), "credits": credit_text(h), "label": label_name(h)}
    return posts.withColumn("_t", parse_title(F.col(title))).withColumns({"artist": F.col("_t.artist"), "album": F.col("_t.album"), **made}).drop("_t")


def page_data(html: Column, schema: str) -> Column:
    """The JSON that a store page holds in ``data-blob`` of its pagedata (or home page) element."""
    blob = lambda i: F.regexp_extract(html, rf'<div[^>]*id="{i}"[^>]*data-blob="([^"]*)"', 1)
    text = once(blob("pagedata"), lambda x: F.when(x != "", x).otherwise(blob("HomepageApp")))
    return F.from_json(unescaped(text), schema)


def discography(bundles: DataFrame, known: DataFrame, key: str, items: str) -> DataFrame:
    """Releases inside bundles that aren't known yet: those with a title and an id (or, lacking that, an art id)."""
    rows = bundles.select(F.explode(items).alias("i")).select(F.coalesce(F.col("i.id"), F.col("i.art_id")).alias(key), F.col("i.title").alias("title"))
    rows = rows.filter(F.col(key).isNotNull() & (F.coalesce("title", F.lit("")) != "")).dropDuplicates([key])
    return rows.join(known.select(key).distinct(), key, "left_anti")


def digital_items(html: Column, schema: str) -> Column:
    """(items, error): the page data's ``digital_items``, or why there are none; ``schema`` is that of an item."""
    none = F.from_json(F.lit("[]"), f"array<{schema}>")

    def told(data: Column) -> Column:
        error = F.when(data.isNull() | data["digital_items"].isNull(), "no page data").when(F.size(data["digital_items"]) == 0, "no items")
        return F.struct(F.coalesce(data["digital_items"], none).alias("items"), error.alias("error"))

    return once(page_data(html, f"digital_items array<{schema}>"), told)


def release_json(fields: dict[str, Column]) -> Column:
    """A release's record as JSON text, null fields too."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
