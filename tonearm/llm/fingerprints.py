"""I-Match document fingerprints, in DataFrame functions only.

The lexicon is the terms whose document frequency lies in a band (shares of all documents), so
very frequent and very rare terms have no say. Its terms fall at random into ``SUBSETS`` lexicon subsets. A text's distinct
lexicon terms are sorted and hashed as a whole and subset by subset; the fingerprint is those hashes. Likeness is the
share of equal ones among the subsets that either text has terms of.

Short texts and those of a large group of near copies, whose terms are all too frequent, have few terms within the band. A
text with fewer than ``FEW`` of them, or than the share ``LEAST_SHARE`` of its terms, is fingerprinted by all its terms, dealt over
the same subsets; a likeness that such a text takes part in compares all terms of both.

A document's edited text takes code points from the next document. Documents are dealt out by ranges of their
order, the next one is a window's lead, and the first document of each range also visits the range before
it. The texts are shuffled once; every later step works within that partitioning.

The lexicon is broadcast: by the band's lower bound it holds at most (mean distinct terms of a document) /
``BAND[0]`` terms at any corpus size. If that exceeds ``MOST_TERMS``, it is joined by shuffle.

Defined results: null and empty texts count as empty; texts without a term have the hash of the text as
fingerprint, so equal texts still agree, and are like others (1) only if equal; the only document is its own next one;
long texts are read whole; rows that repeat an id, or have none, follow one another by id (nulls first) and text; an
empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import read, stored, with_order

#: Lowest and highest document frequency of lexicon terms, as shares of the documents.
BAND = (0.002, 0.01)
#: At most 64: a subset takes 6 bits of a code.
SUBSETS = 64
#: Band terms, and their share of a text's terms, below which all terms count.
FEW = 8
LEAST_SHARE = 0.1
MOST_TERMS = 400_000
DOCS_PER_RANGE = 512
MOST_RANGES = 1 << 20
SEED = "i-match-1"
_SPLIT = r"[\s\p{Punct}]+"
#: A term that every text has, so that texts without lexicon terms keep their rows.
_ALWAYS = 0
#: Bit of a code whose term is outside the band.
_WIDE = 1 << 62


def terms(text: Column, mark: int = 0) -> Column:
    """The hashes of a text's distinct lower-case terms; their two lowest bits hold ``mark``."""
    return F.array_distinct(F.transform(F.split(F.lower(text), _SPLIT), lambda t: F.xxhash64(t).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(mark).cast("long"))))


def coded(h: Column, subsets: int) -> Column:
    """A term's subset in the upper bits, its hash below."""
    return F.shiftleft(F.pmod(F.xxhash64(h, F.lit(SEED)), F.lit(subsets)), 56).bitwiseOR(F.shiftrightunsigned(h, 8))


def lexicon(docs: DataFrame, text_col: str = "text", band=BAND, subsets: int = SUBSETS) -> DataFrame:
    """``h`` (a term's hash) and ``code`` (its subset in the upper bits) for each term within the band."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = texts.count()
    low = max(2, round(band[0] * n))
    high = max(low, round(band[1] * n))
    df = texts.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    kept = df.filter(F.col("df").between(low, high)).select("h", coded(F.col("h"), subsets).alias("code"))
    return stored(kept.union(docs.sparkSession.range(1).select(F.lit(_ALWAYS).cast("long"), F.lit(-1).cast("long"))), "lexicon")


def in_ranges(rows: DataFrame) -> DataFrame:
    """id, rid, part and text: ``part`` cuts the numbers ``rid`` into ranges of equal width."""
    n, low, high = rows.agg(F.count("*"), F.min("rid"), F.max("rid")).first()
    ranges = min(MOST_RANGES, max(1, -(-n // DOCS_PER_RANGE)))
    width = float((high or 0) - (low or 0)) + 1.0
    part = F.least(F.floor((F.col("rid").cast("double") - float(low or 0)) / width * ranges), F.lit(ranges - 1)).cast("long")
    return rows.select("id", "rid", part.alias("part"), "text")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document with the next one in descending order: id, rid, part, text, next_id, next_text, last."""
    rows = in_ranges(with_order(docs, id_col, text_col))
    if (rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 4 * max(DOCS_PER_RANGE, rows.count() // MOST_RANGES):
        # Ids that lie far apart here and close there are numbered one by one first.
        rows = in_ranges(with_order(docs, id_col, text_col, dense=True))
    down = Window.partitionBy("part").orderBy(F.desc("rid"))
    ranked = rows.withColumns({"place": F.row_number().over(down), "next_id": F.lead("id").over(down), "next_text": F.lead("text").over(down), "last": F.lead("rid").over(down).isNull()})
    tops = rows.groupBy("part").agg(F.max("rid").alias("top"))
    # At most MOST_RANGES rows: the range above each, and for the highest the lowest.
    up = Window.orderBy("part")
    hosts = tops.select(F.col("part").alias("of"), F.coalesce(F.lead("part").over(up), F.min("part").over(Window.partitionBy())).alias("part"))
    first = Window.partitionBy("part").orderBy(F.desc("rid"))
    guests = rows.withColumn("place", F.row_number().over(first)).filter("place = 1").select(F.col("part").alias("of"), F.col("id").alias("guest_id"), F.col("text").alias("guest_text"), F.col("rid").alias("guest_rid"))
    guests = guests.join(hosts, "of").select("part", "guest_id", "guest_text", F.lit(True).alias("last"))
    out = ranked.join(guests, ["part", "last"], "left")
    return out.select("id", "rid", "part", "text", "last", F.when(F.col("last"), F.col("guest_id")).otherwise(F.col("next_id")).alias("next_id"), F.when(F.col("last"), F.col("guest_text")).otherwise(F.col("next_text")).alias("next_text"))


def hashes(codes: Column) -> Column:
    """For each subset with terms, in order, a long: the subset in the upper 8 bits, the hash of its sorted codes below.

    Sorted codes stand subset by subset, so one pass chains the hash of each.
    """
    subset = lambda c: F.shiftright(c, 56)
    packed = lambda a: F.shiftleft(a["subset"], 56).bitwiseOR(F.shiftrightunsigned(a["hash"], 8))
    state = lambda s, h, done: F.struct(s.alias("subset"), h.alias("hash"), done.alias("done"))
    none = F.expr("cast(array() as array<bigint>)")
    closed = lambda a: F.when(a["subset"] < 0, none).otherwise(F.array_append(a["done"], packed(a)))
    step = lambda a, c: F.when(a["subset"] == subset(c), state(a["subset"], F.xxhash64(a["hash"], c), a["done"])).otherwise(state(subset(c), F.xxhash64(c), closed(a)))
    return F.aggregate(codes, state(F.lit(-1).cast("long"), F.lit(0).cast("long"), none), step, closed)


def written(codes: Column, prints: Column, own: Column) -> Column:
    """The fingerprint as text: the hash of all terms, then 6 hex digits a subset with terms, its number and hash."""
    whole = F.when(F.size(codes) > 0, F.lpad(F.hex(F.xxhash64(codes)), 16, "0")).otherwise(F.concat(F.lit("t"), F.lpad(F.hex(own), 16, "0")))
    parts = F.transform(prints, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 1, 6))
    return F.lower(F.concat(whole, F.lit("."), F.array_join(parts, "")))


def likeness(a: Column, b: Column, a_text: Column, b_text: Column) -> Column:
    """Equal subset hashes over subsets with terms; texts without any are alike only if equal."""
    subsets = lambda p: F.transform(p, lambda x: F.shiftright(x, 56))
    filled = F.size(F.array_union(subsets(a), subsets(b)))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)) / filled).otherwise((a_text == b_text).cast("double"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band=BAND, subsets: int = SUBSETS) -> DataFrame:
    """Per document: id, n_chars, edited_sha256, both fingerprints, and the likenesses to the edited and to the next text."""
    words = lexicon(docs, text_col, band, subsets)
    if words.count() <= MOST_TERMS:
        words = F.broadcast(words)
    rows = in_order(docs, id_col, text_col)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), F.expr("left(next_text, int(n_chars div 2))")))
    every = F.concat(
        F.array(F.lit(_ALWAYS).cast("long")),
        terms(F.col("text"), 0),
        terms(F.col("edited"), 1),
        F.when(F.col("last"), terms(F.col("next_text"), 2)).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    keys = ["part", "rid", "id", "n_chars", "edited_sha256", "own", "edited_own", "next_own", "next_id", "last"]
    flat = rows.select("part", "rid", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("own"), F.xxhash64("edited").alias("edited_own"), F.xxhash64("next_text").alias("next_own"), "next_id", "last", every.alias("every"))
    # A select of its own: what stands beside explode is computed again for every term.
    # What is known of the text stands beside one of its terms only, so that few bytes are spilled.
    flat = flat.select(*keys, F.explode("every").alias("t")).withColumns({"v": F.col("t").bitwiseAND(F.lit(3)), "h": F.col("t").bitwiseAND(F.lit(-4))})
    flat = flat.select("part", "rid", F.when(F.col("t") == _ALWAYS, F.struct(*keys[2:])).alias("head"), "v", "h").join(words, "h", "left")
    # The empty string between marks is no term.
    wide = coded(F.col("h"), subsets).bitwiseOR(F.lit(_WIDE))
    code = F.when(F.col("h") != F.xxhash64(F.lit("")).bitwiseAND(F.lit(-4)), F.coalesce("code", wide))
    pick = lambda v: F.sort_array(F.collect_list(F.when((F.col("v") == v) & (code >= 0), code))).alias(f"all{v}")
    whole = flat.groupBy("part", "rid").agg(F.first("head", ignorenulls=True).alias("head"), pick(0), pick(1), pick(2)).select("part", "rid", "head.*", "all0", "all1", "all2")
    band_of = lambda v: F.filter(f"all{v}", lambda c: c < _WIDE).alias(f"codes{v}")
    every_of = lambda v: F.sort_array(F.transform(f"all{v}", lambda c: c.bitwiseAND(F.lit(_WIDE - 1)))).alias(f"every{v}")
    whole = whole.select(*keys, *[x for v in (0, 1, 2) for x in (band_of(v), every_of(v))])
    few = lambda v: F.size(f"codes{v}") < F.greatest(F.lit(float(FEW)), F.size(f"every{v}") * LEAST_SHARE)
    whole = whole.select("*", *[few(v).alias(f"few{v}") for v in (0, 1, 2)])
    down = Window.partitionBy("part").orderBy(F.desc("rid"))
    after = lambda c: F.when(F.col("last"), F.col(f"{c}2")).otherwise(F.lead(f"{c}0").over(down)).alias(f"next_{c}")
    whole = whole.select("*", after("few"), F.lag("few0").over(down).alias("few_before"))
    # All terms are hashed only where a comparison takes them: with the edited text, the next text, or the one whose next text this is.
    asked = (F.col("few0") | F.col("few1") | F.col("next_few") | F.coalesce("few_before", F.lit(False)), F.col("few0") | F.col("few1"), F.col("last") & (F.col("few0") | F.col("few2")))
    wide = [F.when(need, hashes(F.col(f"every{v}"))).otherwise(F.expr("cast(array() as array<bigint>)")).alias(f"wide{v}") for v, need in enumerate(asked)]
    whole = whole.select("*", *[hashes(F.col(f"codes{v}")).alias(f"prints{v}") for v in (0, 1, 2)], *wide)
    whole = whole.select("*", after("prints"), after("wide"))
    own = lambda v, c: F.when(F.col(f"few{v}"), F.col(f"every{v}" if c == "codes" else f"wide{v}")).otherwise(F.col(f"{c}{v}"))
    near = lambda other, text: F.when(F.col("few0") | F.col(other.format("few")), likeness(F.col("wide0"), F.col(other.format("wide")), F.col("own"), F.col(text))).otherwise(likeness(F.col("prints0"), F.col(other.format("prints")), F.col("own"), F.col(text)))
    return whole.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        written(own(0, "codes"), own(0, "prints"), F.col("own")).alias("fingerprint"),
        written(own(1, "codes"), own(1, "prints"), F.col("edited_own")).alias("edited_fingerprint"),
        near("{}1", "edited_own").alias("near_edited"),
        near("next_{}", "next_own").alias("near_next"),
        "next_id",
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read(spark, sf_dir, "documents").select("doc_id", "text"))
