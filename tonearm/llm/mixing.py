"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash, laid end to end, and cut into blocks of equal numbers of words. The
schedule maps golden-ratio points (multiples of the golden ratio, modulo 1) through the cumulative slot
shares of the sources, so that every stretch of slots holds the sources in about their shares. The r-th slot of
a source takes its block r modulo the number of its blocks; slots beyond two rounds are dropped.

Ranks and word offsets are running sums in two levels (within bounded buckets, then over the buckets), so a source with any share
of the rows is spread over many tasks. Points meet sources by an equality join on cells of the unit interval.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its own, the
last; repeated rows are separate documents, laid side by side; an empty table, or one without words,
takes nothing. Rows without an id are told apart by their texts. The result depends on nothing else, so reruns agree. Other columns are not read.

Words are counted once, in one pass over the texts; ids, sizes and sources are stored. Windows without a partition run over the sources,
one row each; :func:`targets` refuses more than ``MOST_SOURCES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import WORD_PATTERN, read, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words in a block, and the least number of blocks of a source with as many words.
BLOCK = 512
LEAST_BLOCKS = 64
SEED = "mix-1"
#: The golden ratio's fractional part in units of 2 ** -31, made odd so that its multiples run through all of them.
STEP = 1327217885
UNIT = 1 << 31
CELLS = 1 << 12
#: Sources that one task may weigh against each other.
MOST_SOURCES = 1_000_000
SLOT_RUN = 1 << 16


def with_size(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows with ``size`` in words and ``src``: the source, marked so that null comes after all others."""
    src = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.withColumns({"size": words, "src": src})


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source its size, target, block length and numbers of blocks and wanted slots.

    The sources are one small table: a row each, however many documents. Ordered by the level at which they
    fill up, those below the common level stop at ``most`` times their size.
    """
    sizes = stored(rows.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    by_name = Window.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = most * F.col("source_size")
    s = sizes.withColumn("w", weight).withColumn("full_at", full / F.col("w"))
    up = Window.orderBy("full_at", "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(up), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("fills", F.col("full_at") <= F.col("level"))
    first_open = F.min(F.when(~F.col("fills"), F.struct("full_at", "src", "level"))).over(every)
    stops = F.coalesce(F.struct("full_at", "src") < F.struct(first_open["full_at"], first_open["src"]), F.lit(True))
    s = s.withColumn("stops", stops).withColumn("common", first_open["level"])
    target = F.when(F.col("stops"), full.cast("double")).otherwise(F.col("w") * F.col("common"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")
    s = s.select("src", "source_size", F.round(target, 6).alias("target"), block.alias("block_words"))
    return s.withColumn("blocks", F.expr("(source_size + block_words - 1) div block_words")).withColumn("slots", F.col("target") / F.col("block_words"))


def schedule(plan: DataFrame) -> DataFrame:
    """``slot``, ``src`` and ``block``: which block of which source each slot of the mix takes."""
    spark = plan.sparkSession
    total = plan.agg(F.sum("slots")).first()[0] or 0.0
    n = int(total + 0.5)
    ahead = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("slots").over(ahead), F.lit(0.0))
    bound = lambda x: F.floor(x / F.lit(total or 1.0) * UNIT).cast("long")
    spans = plan.select("src", "blocks", bound(low).alias("low"), bound(low + F.col("slots")).alias("high")).filter("low < high")
    cell = UNIT // CELLS
    spans = spans.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"least((high - 1) div {cell}, {CELLS - 1})"))))
    parts = max(1, n // (4 * SLOT_RUN))
    slots = spark.range(0, n, 1, parts).withColumnRenamed("id", "slot").withColumn("point", F.expr(f"(slot % {UNIT}) * {STEP} % {UNIT}")).withColumn("cell", F.expr(f"point div {cell}"))
    placed = slots.join(spans, "cell").filter("point >= low and point < high").select("slot", "src", "blocks", F.expr(f"slot div {SLOT_RUN}").alias("run"))
    runs = placed.groupBy("src", "run").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("src", "run").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(runs.select("src", "run", base.alias("base")), ["src", "run"])
    rank = F.col("base") + F.col("within")
    return ranked.filter(rank < MOST * F.col("blocks")).select("slot", "src", (rank % F.col("blocks")).alias("block"))


def laid_out(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows with ``begin``, their first word's place in the shuffled source."""
    key = F.md5(F.concat_ws("#", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("mark").cast("string")))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    base = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("src", "bucket").orderBy("key", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("size").over(order), F.lit(0))
    return keyed.withColumn("within", within).join(sums.select("src", "bucket", base.alias("base")), ["src", "bucket"]).select("id", "src", "size", (F.col("base") + F.col("within")).alias("begin"))


def pieces(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``src``, ``block``, ``begin`` and ``words``: the documents' shares of the blocks (documents by their place)."""
    spans = rows.filter("size > 0").join(plan.select("src", "block_words"), "src")
    spans = spans.select("src", "begin", "size", "block_words", F.explode(F.expr("sequence(begin div block_words, (begin + size - 1) div block_words)")).alias("block"))
    words = F.least(F.expr("begin + size"), F.expr("(block + 1) * block_words")) - F.greatest(F.col("begin"), F.expr("block * block_words"))
    return spans.select("src", "block", "begin", words.alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, ``src``, source_size, target, and taken: the words that the mix takes of it."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    mark = F.when(F.col("id").isNull(), F.xxhash64("text")).alias("mark")
    rows = stored(with_size(named).select("id", "size", "src", mark), "sizes")
    plan = targets(rows)
    placed = laid_out(rows)
    times = schedule(plan).groupBy("src", "block").agg(F.count("*").alias("times"))
    taken = pieces(placed, plan).join(times, ["src", "block"]).groupBy("src", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    full = placed.withColumn("held", F.col("size") > 0)
    out = full.join(taken.withColumn("held", F.lit(True)), ["src", "begin", "held"], "left").join(plan.select("src", "source_size", "target"), "src")
    return out.select(F.col("id").alias(id_col), "size", "src", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("src")
