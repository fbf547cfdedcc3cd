"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.sources.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links(a, b)``; self-links and nulls give none.

    Each round hangs every node's larger neighbours on its least one and then what remains on the least parent, so the number of
    rounds grows with the logarithm of the longest chain. Links that are stars already take no round. A round ends in one stored table; minima are
    combined before they are shuffled, so a node with very many links splits over tasks.
    """
    edges = _downward(links.select("a", "b"))
    while not _stars(edges):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _downward(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(parent, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_downward(rest.union(parent.select("a", F.col("m").alias("b")))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and on none that hangs itself."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    deep = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return twice.union(deep).isEmpty()
