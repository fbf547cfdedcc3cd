"""SimHash near-duplicates, linked through one Gray-order hierarchical index over all fingerprints.

All distinct fingerprints are sorted by Gray rank into ranges (the upper nodes, at most ``MOST_NODES``). A node keeps the
bits that all its fingerprints share, as value and mask; the nodes have a tree of their own above them. Each
fingerprint searches that tree, differences add up on the way down over the bits that a node shares and its parent does not, and what
exceeds ``DISTANCE`` drops the whole group. So a fingerprint visits only the nodes that may hold a partner. The task of a
node builds the same kind of tree over the node's own fingerprints and searches it with those and with the
visitors. It emits links that span the components it saw, never all pairs; components then merge across nodes.

A fingerprint visits 1 + d + d(d - 1)/2 nodes at most about, half of them by order, where 2^d is the number of nodes. Each text is
read once, by Python; fingerprints are stored.

Defined results: null and empty texts have fingerprint zero, linked like any other; long texts are read
whole; repeated rows have one fingerprint and so one component; ids that are null get rows of their own and
never name a component (a component of null ids only has none); an empty table gives no rows. Only ``id_col``
and ``text_col`` are read.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import read, stored
from tonearm.llm.components import connected_components

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Children of a node of the trees.
FAN = 8
#: Fingerprints that an upper node holds, as long as there are not too many nodes; nodes for each task; the most upper nodes.
NODE = 32_768
NODES_PER_TASK = 8
MOST_NODES = 1 << 16
#: Fingerprints that search a tree together.
BLOCK = 1024
#: A fingerprint of more than this share of all rows is met by broadcast; there can be no more than 1 / HOT of them.
HOT = 0.001
ALL = ~np.uint64(0)


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; ASCII letters count as lower case."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    if words == 3 and n > 1:
        hashes = [digest(b"%b %b %b" % x, seed) for x in zip(w, w[1:], w[2:])]
    else:
        hashes = [digest(b" ".join(w[i : i + words]), seed) for i in range(n)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        part = np.array(hashes[at : at + 8192], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed long, for every row."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, words, seed) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_order(fp: str) -> Column:
    """The Gray rank of a long as a signed long of the same order."""
    return F.expr(f"aggregate(array(1, 2, 4, 8, 16, 32), {fp}, (r, s) -> r ^ shiftrightunsigned(r, s))").bitwiseXOR(F.lit(-1 << 63))


class GrayIndex:
    """A tree over patterns in Gray order, each a value and a mask of the bits it knows (all, if no mask is given).

    ``levels`` go from the patterns up: value, and ``own``, the known bits that the parent does not know. What the
    children share stands once, in the parent.
    """

    def __init__(self, value: np.ndarray, mask: np.ndarray | None = None):
        mask = np.full(len(value), ALL) if mask is None else mask
        self.levels = []
        while True:
            cuts = np.arange(0, len(value), FAN)
            ones, zeros = (np.bitwise_and.reduceat(x & mask, cuts) if len(x) else x for x in (value, ~value))
            up = ones | zeros if len(value) > FAN else np.zeros(min(1, len(value)), dtype=np.uint64)
            self.levels.append((value, mask & ~np.repeat(up, FAN)[: len(value)]))
            if len(value) <= FAN:
                return
            value, mask = ones, up

    def near(self, fps: np.ndarray, distance: int = DISTANCE):
        """(place in ``fps``, pattern) of those that differ in at most ``distance`` known bits, in blocks."""
        top = len(self.levels[-1][0])
        for at in range(0, len(fps), BLOCK):
            part = fps[at : at + BLOCK]
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            differ = np.zeros(len(q), dtype=np.uint8)
            for level in range(len(self.levels) - 1, -1, -1):
                value, own = self.levels[level]
                differ = differ + np.bitwise_count((part[q] ^ value[node]) & own[node])
                keep = differ <= distance
                q, node, differ = q[keep], node[keep], differ[keep]
                if level:
                    below = len(self.levels[level - 1][0])
                    q, differ = np.repeat(q, FAN), np.repeat(differ, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    if len(node) and node.max() >= below:
                        inside = node < below
                        q, node, differ = q[inside], node[inside], differ[inside]
            yield at + q, node


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the components of the linked places; ``root`` names the least place of each."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root[:] = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]


class Node:
    """The fingerprints of an upper node, in Gray order, and the links found between them and to visitors."""

    def __init__(self, fps: np.ndarray, distance: int = DISTANCE):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.distance = distance
        self.index = GrayIndex(self.fps)
        self.root = np.arange(len(fps))
        for a, b in self.index.near(self.fps, distance):
            own = a < b
            join_roots(self.root, a[own], b[own])

    def visit(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A link for each visitor that has a partner here; partners of one visitor become one component."""
        n = len(self.fps)
        root = np.concatenate([self.root, np.arange(n, n + len(fps))])
        for a, b in self.index.near(fps, self.distance):
            join_roots(root, b, a + n)
        self.root = root[:n].copy()
        met = np.flatnonzero(root[n:] < n)
        return fps[met], self.fps[root[n + met]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that span the components of the node's own fingerprints."""
        far = np.flatnonzero(self.root != np.arange(len(self.fps)))
        return self.fps[far], self.fps[self.root[far]]


def upper_nodes(fps: DataFrame, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first Gray ranks of the ranges but the first, and for each range the value and the mask that its fingerprints share."""
    ranked = fps.select("fp", gray_order("fp").alias("rank"))
    at = [i / nodes for i in range(1, nodes)]
    edges = ranked.agg(F.percentile_approx("rank", at, 16 * nodes)).first()[0] if at else []
    edges = np.unique(np.array(edges or [], dtype=np.int64)).view(np.uint64) ^ np.uint64(1 << 63)

    def shared(batches):
        for pdf in batches:
            fp = np.sort(pdf["fp"].to_numpy().view(np.uint64))
            node = node_of(edges, fp)
            order = np.argsort(node, kind="stable")
            fp, node = fp[order], node[order]
            cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
            both = [f.reduceat(fp, cuts).view(np.int64) if len(cuts) else np.zeros(0, np.int64) for f in (np.bitwise_and, np.bitwise_or)]
            yield pd.DataFrame({"node": node[cuts].astype(np.int64), "every": both[0], "some": both[1]})

    rows = fps.select("fp").mapInPandas(shared, "node long, every long, some long").groupBy("node").agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some")).toPandas()
    value, mask = np.zeros(len(edges) + 1, dtype=np.uint64), np.full(len(edges) + 1, ALL)
    own = rows["node"].to_numpy(dtype=np.int64)
    value[own] = rows["every"].to_numpy(dtype=np.int64).view(np.uint64)
    mask[own] = value[own] | ~rows["some"].to_numpy(dtype=np.int64).view(np.uint64)
    return edges, value, mask


def node_of(edges: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, gray_rank(fp), side="right")


def near_links(fps: DataFrame, distance: int = DISTANCE, node_size: int = NODE) -> DataFrame:
    """``a`` and ``b``: links between distinct fingerprints of ``fps(fp)`` that span all components."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = int(min(max(NODES_PER_TASK * parts, fps.count() // node_size), MOST_NODES))
    shared = spark.sparkContext.broadcast(upper_nodes(fps, nodes))

    def route(batches):
        edges, value, mask = shared.value
        tree = GrayIndex(value, mask)
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            own = node_of(edges, fp)
            to, who, home = [own], [np.arange(len(fp))], [np.ones(len(fp), bool)]
            for q, node in tree.near(fp, distance):
                # Of two nodes one visits the other, in turn the earlier and the later, so that none has all visitors.
                go = np.where((node + own[q]) % 2 == 0, own[q] < node, own[q] > node)
                to.append(node[go])
                who.append(q[go])
                home.append(np.zeros(int(go.sum()), bool))
            to, who, home = map(np.concatenate, (to, who, home))
            order = np.lexsort((~home, to))
            to, who, home = to[order], who[order], home[order]
            cuts = np.flatnonzero((to[1:] != to[:-1]) | (home[1:] != home[:-1])) + 1
            first = np.concatenate([[0], cuts]) if len(to) else np.zeros(0, np.int64)
            yield pd.DataFrame({"node": to[first], "visit": ~home[first], "fps": [x.tobytes() for x in np.split(fp[who], cuts)][: len(first)]})

    routed = fps.select("fp").mapInPandas(route, "node long, visit boolean, fps binary")
    routed = routed.repartition(parts, "node").sortWithinPartitions("node", "visit")

    def meet(batches):
        rows = (row for pdf in batches for row in zip(pdf["node"], pdf["visit"], pdf["fps"]))
        for _, pieces in groupby(rows, key=itemgetter(0)):
            own, out = Node(np.zeros(0, dtype=np.uint64)), []
            for visit, some in groupby(pieces, key=itemgetter(1)):
                parts = (np.frombuffer(x[2], dtype=np.uint64) for x in some)
                if visit:
                    out += [own.visit(x) for x in gathered(parts, NODE)]
                else:
                    own = Node(np.concatenate(list(parts)), distance)
            out.append(own.forest())
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pd.DataFrame({"a": a, "b": b})

    return routed.mapInPandas(meet, "a long, b long")


def gathered(parts, most: int):
    """Arrays joined until they hold ``most`` values."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``id_col``, fingerprint (hex) and component_id (the smallest id reachable over links) of every row.

    Rows meet the component of their fingerprint in a join; the few fingerprints that many rows share are met by
    broadcast, so no task gets all rows of one.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    kinds = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "kinds")
    roots = connected_components(near_links(kinds.select("fp"), distance))
    of = kinds.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), "least")
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(of.join(tops, "root").select("fp", "n", "component_id"), "named")
    most = prints.count() * HOT
    often = F.broadcast(named.filter(F.col("n") > most).select("fp", F.col("component_id").alias("_often"), F.lit(True).alias("_met")))
    rows = prints.join(often, "fp", "left")
    rest = rows.filter("_met is null").select("fp", id_col).join(named.filter(F.col("n") <= most), "fp")
    every = rows.filter("_met").select("fp", id_col, F.col("_often").alias("component_id")).union(rest.select("fp", id_col, "component_id"))
    return every.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
