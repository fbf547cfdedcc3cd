"""Connected components of a link table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import shared_dir


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``links(a, b)``.

    Each round hangs a node's neighbours on its smallest neighbour, with a shuffle of the links that are
    left; the number of rounds grows with the logarithm of the number of nodes. Minima are
    combined before they are shuffled and join back on a unique side, so a node with very many links
    splits over tasks. Rounds end in a checkpoint. No links: no rows. Self-links and repeats are ignored.
    """
    shared_dir(links.sparkSession)
    edges = _ordered(links.select("a", "b"))
    edges = edges.checkpoint()
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _ordered(small.union(down.select("a", F.col("m").alias("b")))).checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
