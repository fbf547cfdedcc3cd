"""From raw documents to a training mix: five stages, each a corpus operator at work on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents; the last adds size, source_size, target and taken, and leaves out documents of which the mix takes nothing.

Defined results of every stage: a null text counts as empty, an empty table gives an empty one, rows that repeat an id or have none are rows of
their own. Extra columns stay as they are, whatever their names. An empty text is rejected or kept by its score like any other; of all empty
ones the SimHash stage keeps the first; the stages after it leave it alone, and the mix never takes it. Of equal rows the first in order stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import decontaminate, mixing, quality, simhash, substrings
from tonearm.llm.common import fold, read, stored, with_order


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns as its query does."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.keep_good(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each SimHash component, by id and text; rows without an id come after those with one.

    Rows are told apart by their own number, not by ``doc_id``, so ids may repeat or be null.
    """
    own = F.when(F.col("id").isNull(), F.col("rid") + F.lit(1 << 62)).otherwise(F.col("rid"))
    rows = with_order(docs, "doc_id", "text", docs.columns).select(own.alias("rid"), "text", "other")
    named = simhash.simhash_components(rows.select("rid", "text"), "rid")
    kept = rows.join(named.filter("rid = component_id").select("rid"), "rid", "left_semi")
    return kept.select(*[F.col(f"other.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier; texts that lose everything go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = substrings.drop_repeats(docs, carry=others)
    text = F.when(F.size("removed") == 0, F.decode("kept", "UTF-8")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    out = cut.filter("size(removed) = 0 or octet_length(kept) > 0").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, source_size, target and taken, the words that the mix takes of each; they replace columns of those names.

    Rows are told apart by their own number, so ids may repeat or be null.
    """
    rows = with_order(docs, "doc_id", "text", docs.columns)
    source = F.col(f"other.c{docs.columns.index('source')}").alias("source")
    found = mixing.mix(rows.select("rid", "text", source), "rid").filter("taken > 0").drop("src")
    added = ["size", "source_size", "target", "taken"]
    kept = [F.col(f"other.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added]
    return rows.join(found, "rid").select(*kept, *added)


STAGES = [
    ("quality", keep_quality),
    ("simhash", keep_one_of_each_group),
    ("substrings", drop_repeated_passages),
    ("decontaminate", drop_leaked_benchmarks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL expresses the classifier's stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None
