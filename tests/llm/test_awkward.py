"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns: each has a defined result."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, awkward, docs_df
from tonearm.llm import brown, chat, decontaminate, fingerprints, html, mixing, quality, sharding, simhash, substrings, toxicity
from tonearm.llm.common import with_order

LABELS = [(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, 0, 1), (8, 0, 1), (9, 1, 0), (10, None, None), (None, 1, 1), (999, 1, 1)]


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda spark, d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels(spark), F.lit(True))),
    "fingerprints": lambda spark, d: fingerprints.fingerprint_edits(d),
    "substrings": lambda spark, d: substrings.drop_repeats(d),
    "decontaminate": lambda spark, d: decontaminate.find_leaks(d, spark.createDataFrame([(1, "quick brown fox jumps over the lazy"), (None, None), (2, "")], "item_id long, text string")),
    "mixing": lambda spark, d: mixing.mix(d),
    "simhash": lambda spark, d: simhash.simhash_components(d),
    "quality": lambda spark, d: quality.score_quality(d, quality.fit_quality(d, labels(spark), F.lit(True))),
    "sharding": lambda spark, d: sharding.shard_documents(d, 4),
    "brown": lambda spark, d: brown.brown_scores(d, F.col("doc_id") % 2 == 0),
}


def comparable(rows):
    return Counter(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_once_whatever_it_holds(spark, name):
    rows = OPERATORS[name](spark, docs_df(spark)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in awkward())


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(spark, name):
    run = OPERATORS[name]
    assert comparable(run(spark, docs_df(spark)).collect()) == comparable(run(spark, docs_df(spark, extra=True)).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](spark, docs_df(spark, [])).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text"), (4, "u", "<!-- never ends"), (5, "u", "plain &amp; simple text"), (5, "u", "plain &amp; simple text")]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0) for r in out) == [0, 1, 2, 4, 5, 5]
    assert {r["text"] for r in out if r["page_id"] in (1, 2, 4)} == {""}
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_chats(spark):
    kind = "conv_id long, turn long, role string, text string, conv string, t string"
    rows = [(1, 0, None, None, "", ""), (1, 1, "assistant", "", "", ""), (2, None, "assistant", "[INST]\\[/INST]</s>", "", ""), (2, None, "assistant", "[INST]\\[/INST]</s>", "", ""), (None, 0, "user", "hi", "", ""), (3, 0, "assistant", "long text " * 20000, "", "")]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, kind))).collect()}
    assert set(out) == {1, 2, 3, None} and out[2]["loss_chars"] == 2 * len("[INST]\\[/INST]</s>") and out[3]["loss_chars"] == 200000
    assert chat.format_chats(spark.createDataFrame([], kind)).collect() == []


@pytest.mark.parametrize("kind", ["long", "string", "date", "double"])
@pytest.mark.parametrize("parts", [8, 700, 2000])
def test_numbers_follow_ids_of_any_type_and_any_number_of_partitions(spark, kind, parts):
    rows = [(r[0], *r[1:]) for r in awkward()] + [(1000 + i // 3, f"text {i % 2}", "en", "web", 6) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    own = F.expr("date_add(date'2020-01-01', int(doc_id))") if kind == "date" else F.lpad(F.col("doc_id").cast("string"), 6, "0") if kind == "string" else F.col("doc_id").cast(kind)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = with_order(docs.withColumn("own", own), "own", "text", ["doc_id"]).select("rid", "text", "other.c0").orderBy("rid").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert [r["rid"] for r in out] == list(range(len(rows)))
    ids = [r["c0"] for r in out]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert Counter((r["c0"], r["text"]) for r in out) == Counter((r[0], r[1] or "") for r in rows)


@pytest.mark.parametrize("name", ["simhash", "substrings", "sharding", "fingerprints"])
def test_text_ids_that_repeat(spark, name):
    docs = docs_df(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    if name == "simhash":
        docs = with_order(docs, "doc_id", "text", ["doc_id"]).select("rid", "text", "other.c0")
        rows = simhash.simhash_components(docs, "rid").collect()
        assert len(rows) == len(awkward())
        return
    rows = OPERATORS[name](spark, docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] and f"d{r[0]}" for r in awkward())
