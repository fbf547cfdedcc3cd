"""Ranked lexical search over a bit-sliced impact index.

Each text is read once for its length and its counts of the items' terms. With the counts of the whole table a term's occurrences in a document
become one integer, its impact. Documents are taken in blocks of ``BLOCK``; in a block every term has one bitmap for each bit of its impacts.
The bitmaps of an item's terms are added by bitwise carry arithmetic, for many items at once, which gives all documents' scores as
bitmaps. The best are found from the most significant bitmap down: while more than ``k`` documents have a bit, only they stay; otherwise they are taken and
the others stay. Documents that are left at the end have equal scores and go by id. Nothing is pruned by guess, so results are exact.

A task keeps the best ``k`` of each item over its blocks; those meet in two steps, by hashes of ids and then by item, so what one task gets
does not grow with the number of tasks. The items are held by the tasks in groups of at most ``ITEM_BYTES``; more items take more passes over the documents.

Defined results: null texts and texts without a term are not documents (N) and are never found; null or empty items, and items whose terms stand
nowhere, have no rows; repeated rows are documents of their own, as are rows without an id, which come last among equal scores; repeated items are each answered;
very long texts are cut at separators while they are counted, so memory stays bounded; empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import discard, read, stored

#: Documents in a block, bytes of items in one pass, items added at once, bitmaps' terms held at once, bytes of text that are split at once.
BLOCK, ITEM_BYTES, ITEMS, TERMS, PIECE = 8192, 4 << 20, 256, 2048, 1 << 20
_WORDS = BLOCK // 64
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those that start within about ``PIECE`` bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def item_groups(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple]]:
    """(id, counts of terms) of the items, in lists whose texts take ``most_bytes`` together, or one item more."""
    group, size = [], 0
    for row in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        counts = Counter()
        for some in pieces(row[1]):
            counts.update(some)
        if counts:
            group.append((row[0], counts))
            size += len(row[1])
        if size >= most_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def postings(docs: DataFrame, codes: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` (its terms), ``terms`` (codes of the wanted ones, ascending) and ``counts`` of every text with a term."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        known = shared.value
        for batch in batches:
            n, ends, terms, counts = [], [0], [], []
            for text in batch.column("text"):
                size, found = 0, Counter()
                for some in pieces(text.as_py()):
                    size += len(some)
                    found.update([known[w] for w in some if w in known])
                code = np.fromiter(found, dtype=np.int32, count=len(found))
                order = np.argsort(code)
                n.append(size)
                ends.append(ends[-1] + len(found))
                terms.append(code[order])
                counts.append(np.fromiter(found.values(), dtype=np.int64, count=len(found))[order])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *some]))) for some, kind in ((terms, np.int32), (counts, np.int64))]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column("n"), 0))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<long>")


class Items:
    """Items in chunks of at most ``ITEMS``; each is a matrix of (term, times) entries, one row an item, -1 where it has no more."""

    def __init__(self, items: list[tuple], codes: dict[bytes, int]):
        self.chunks = []
        for at in range(0, len(items), ITEMS):
            some = [sorted((codes[w], q) for w, q in counts.items()) for _, counts in items[at : at + ITEMS]]
            entries = sorted({e for x in some for e in x})
            place = {e: i for i, e in enumerate(entries)}
            matrix = np.full((len(some), max(map(len, some))), -1, dtype=np.int64)
            for i, x in enumerate(some):
                matrix[i, : len(x)] = [place[e] for e in x]
            self.chunks.append((at, np.array(entries, dtype=np.int64), matrix))


class Block:
    """The bit-sliced index of at most ``BLOCK`` documents, which come in the order in which equal scores are taken."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], m: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.most, term, impact)

    def slices(self, entries: np.ndarray, depth: int) -> np.ndarray:
        """[entry, bit, 64 documents]: the bits of each entry's impact times its repeats; the last entry, of no term, is empty."""
        out = np.zeros((len(entries) + 1, depth, _WORDS), dtype=np.uint64)
        plane = np.zeros((depth, BLOCK), dtype=np.uint8)
        bits = np.arange(depth)[:, None]
        for i, (term, times) in enumerate(entries):
            docs = self.doc[self.first[term] : self.first[term + 1]]
            if len(docs):
                plane[:, docs] = (self.impact[self.first[term] : self.first[term + 1]] * times >> bits) & 1
                out[i] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
                plane[:, docs] = 0
        return out

    def scores(self, entries: np.ndarray, matrix: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of all documents' scores, least significant first, each [item, 64 documents]."""
        bound = np.append(self.most[entries[:, 0]] * entries[:, 1], 0)
        total = [np.zeros((len(matrix), _WORDS), dtype=np.uint64) for _ in range(int(bound[matrix].sum(axis=1).max()).bit_length())]
        columns, start = matrix.shape[1], 0
        while start < columns:
            step = columns - start
            while len(used := np.unique(matrix[:, start : start + step])) > TERMS and step > 1:
                step = step // 2
            used = used[used >= 0]
            depth = int(bound[used].max()).bit_length()
            index = self.slices(entries[used], depth)
            for column in range(start, start + step):
                add(total, index, np.where(matrix[:, column] < 0, len(used), np.searchsorted(used, matrix[:, column])))
            start += step
        return total


def add(total: list[np.ndarray], index: np.ndarray, rows: np.ndarray) -> None:
    """Adds the numbers whose bits ``index[rows]`` holds to those that ``total`` holds, one bit of all of them at a time."""
    carry = None
    for bit, held in enumerate(total):
        if bit < index.shape[1]:
            more = index[rows, bit]
            half = held ^ more
            over = held & more
            if carry is not None:
                over |= half & carry
                half ^= carry
            total[bit], carry = half, over
        else:
            if carry is None or not carry.any():
                break
            total[bit], carry = held ^ carry, held & carry


def best(total: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of the ``k`` highest scores above 0 of each item; of equal ones the first documents."""
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = np.bitwise_or.reduce(total)
    taken = np.zeros_like(open_)
    for held in reversed(total):
        have = open_ & held
        many = (np.bitwise_count(taken).sum(axis=1) + np.bitwise_count(have).sum(axis=1) > k)[:, None]
        taken = np.where(many, taken, taken | have)
        open_ = np.where(many, have, open_ & ~held)
    flat = np.unpackbits(taken.view(np.uint8), axis=1, bitorder="little").astype(bool)
    rest = np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little").astype(bool)
    need = k - flat.sum(axis=1, keepdims=True)
    flat |= rest & (np.cumsum(rest, axis=1) <= need)
    item, doc = np.nonzero(flat)
    score = np.zeros(len(item), dtype=np.int64)
    for bit, held in enumerate(total):
        score |= (held[item, doc >> 6] >> (doc & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << bit
    return item, doc, score


def _order(value) -> tuple:
    return (value is None, 0 if value is None else value)


def _rank(index: DataFrame, items: list[tuple], codes: dict[bytes, int], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``item`` (its place in the list), ``id`` and ``score``: the best ``k`` of each item within each task's documents."""
    kind = index.schema["id"].dataType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast((Items(items, codes), weights))

    def run(batches):
        wanted, weight = shared.value
        found: dict[int, list] = {}

        def search(rows: list[tuple]) -> None:
            rows.sort(key=lambda r: _order(r[0]))
            m = 75 + (25 * np.array([r[1] for r in rows], dtype=np.int64) * documents) // length
            block = Block([r[2] for r in rows], [r[3] for r in rows], m, weight)
            for at, entries, matrix in wanted.chunks:
                for i, d, s in zip(*map(np.ndarray.tolist, best(block.scores(entries, matrix), k))):
                    found.setdefault(at + i, []).append((-s, _order(rows[d][0])))
            for i, hits in found.items():
                hits.sort()
                del hits[k:]

        rows: list[tuple] = []
        ids = pa.null()
        for batch in batches:
            ids = batch.schema.field("id").type
            terms, counts = batch.column("terms"), batch.column("counts")
            ends, codes_, tf = terms.offsets.to_numpy(), terms.values.to_numpy(), counts.values.to_numpy()
            for i, (id_, n) in enumerate(zip(batch.column("id").to_pylist(), batch.column("n").to_pylist())):
                rows.append((id_, n, codes_[ends[i] : ends[i + 1]], tf[ends[i] : ends[i + 1]]))
                if len(rows) == BLOCK:
                    search(rows)
                    rows = []
        if rows:
            search(rows)
        out = [(i, None if key[0] else key[1], -s) for i, hits in found.items() for s, key in hits]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], ids), pa.array([o[2] for o in out], pa.int64())], ["item", "id", "score"])

    return index.filter("size(terms) > 0").mapInArrow(run, f"item long, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_col``, ``rank``, ``id_col`` and ``score``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    kinds = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kinds[0]}, rank int, {id_col} {kinds[1]}, score long")
    for group in item_groups(items, item_col, item_text, most_bytes):
        codes = {w: i for i, w in enumerate(sorted({w for _, counts in group for w in counts}))}
        index = stored(postings(docs, codes, id_col, text_col), "postings")
        documents, length = index.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            discard(index)
            return out
        # At most one count for each of the group's terms, whatever the number of documents.
        holding = dict(map(tuple, index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect()))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(codes))], dtype=np.int64)
        hits = _rank(index, group, codes, weights, documents, length, k)
        by_score = (F.desc("score"), F.col("id").asc_nulls_last())
        for keys in (["item", F.pmod(F.xxhash64("id"), F.lit(64))], ["item"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(group)], f"item long, name {kinds[0]}")
        found = hits.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = out.union(stored(found, "ranks"))
        discard(index)
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counts GROUP BY term), whole
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // len)))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), whole
  GROUP BY item_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
