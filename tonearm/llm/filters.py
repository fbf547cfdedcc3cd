"""Filter interaction audit by a mask histogram.

Five filters are read off each whole text by column functions, as one five-bit mask of failures. Equal texts meet by a digest, whose least
``doc_id`` is the one that the last filter lets pass. Every order of the filters then follows from the counts of the 32 masks in each part, so the
documents are read once, not once for each order.

Defined results: a null text counts as empty, which has no words and fails only A. A null source is the part ``''``. A row without an id never fails E
and makes no other row fail it; rows that repeat both id and text all pass it. Labels of an id that repeat count as 1 if one of them is 1; null labels and those
of unknown ids count for nothing. Repeated rows are each counted. An empty table has no parts and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import read, stored

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
BIT = {c: 1 << i for i, c in enumerate(LETTERS)}
CELL = "array<struct<mask:int,n:bigint,good:bigint,toxic:bigint>>"


def text_mask(text: Column, words: Column) -> Column:
    """The bits of A to D: few words, few distinct words, many capitals, odd characters."""
    n, chars = F.size(words), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < 50,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * chars,
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum([F.when(bad, BIT[c]).otherwise(0) for c, bad in fails.items()], F.lit(0))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id``, ``part`` and ``mask`` of every document; the texts are read once and only their digests are shuffled.

    A text's first row joins back by its id, not by the text, so a group of equal texts of any size is dealt out evenly.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bare = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    facts = stored(rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("own")), "masks")
    first = facts.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    both = facts.join(first, ["id", "digest"], "left")
    again = F.col("id").isNotNull() & F.col("first").isNull()
    return both.select("id", "part", (F.col("own") + F.when(again, BIT["E"]).otherwise(0)).alias("mask"))


def histogram(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and ``cells``, at most 32: how many documents have each mask, and how many of them are labelled good or toxic."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    cells = masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).cast(CELL).alias("cells"))


def audit(cells: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, what the step's filter does to the documents that reach it.

    A filter removes a document where it stands first among those that the document fails, which it does in 120 / f of the orders if these are f; so ``shapley``,
    the sum over all orders, needs no second pass over them.
    """

    def total(hit, field: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(hit(c["mask"]), c[field]).otherwise(0))

    steps = cells.select("part", "cells", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).filter("letter <> ''")
    bits = F.create_map(*[x for c, b in BIT.items() for x in (F.lit(c), F.lit(b))])
    steps = steps.withColumns({"bit": bits[F.col("letter")], "step": F.col("at") + 1})
    earlier = F.slice(F.split("filter_order", ""), 1, F.col("at"))
    steps = steps.withColumn("before", F.aggregate(earlier, F.lit(0), lambda a, c: a + bits[c]))

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(F.col("bit")) != 0) & (m.bitwiseAND(F.col("before")) == 0)

    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(F.col("bit")) != 0, (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: m.bitwiseAND(F.col("before") + F.col("bit")) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: (m.bitwiseAND(F.col("bit")) != 0) & (m.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        shares.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    return audit(histogram(masked(docs, id_col, text_col, part_col), labels))


def op13_filters(spark, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < words.doc_id THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN known ON words.doc_id = known.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM masks GROUP BY part, mask),
letters(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
  SELECT filter_order, step, (SELECT bit FROM letters WHERE c = substr(filter_order, step, 1)) AS bit,
    (SELECT coalesce(sum(bit), 0)::INT FROM letters WHERE strpos(filter_order, c) < step) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
