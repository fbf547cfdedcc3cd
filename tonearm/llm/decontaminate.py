"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared in lower case, with every run of other ASCII characters than letters
and digits read as one space. An item of ``m`` bytes may be matched with ``k = floor(RATE * m)`` edits. By the q-gram
lemma such a match shares ``m + 1 - q - k * q`` q-grams with the item, all within ``k`` diagonals of its own; the
shared q-grams are counted in diagonal bands that overlap by half, so that each match lies whole in one.
Bands that reach the bound are verified by alignment within the band. A q-gram of a text counts once in a band, however often the item repeats it, since a match
gives it one place; and hits are counted ``HITS`` at a time, so repeated and frequent q-grams cost time, not memory.

The benchmark is held by the tasks in blocks of at most ``BLOCK_BYTES``, one at a time; a larger one takes more passes
over the documents, whose hits meet in a join.

Defined results: null and empty texts, and texts shorter than an item less its edits, have no match with it;
items under ``MIN_ITEM`` bytes once normalised are matched without edits, as whole words, those under ``Q`` bytes by a look-up of the text's words;
those that are null or empty match nothing. For others ``k`` is reduced until the bound is at
least one q-gram; long texts are read whole; repeated rows and repeated items are each reported; an empty
benchmark leaves every document clean. Only the named columns are read; the filter returns all columns as they are.
"""

from __future__ import annotations

import string
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import read, stored, with_order

Q = 8
RATE = 0.1
MIN_ITEM = 24
BLOCK_BYTES = 16 << 20
CHUNK = 1 << 19
HITS = 1 << 20
_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = bytes(c if c >= 128 or chr(c) in string.ascii_letters + string.digits else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split())


def grams(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as numbers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for r in range(min(Q, n)):
        part = np.frombuffer(data, dtype="<u8", offset=r, count=(len(data) - r) // 8)
        out[r::Q] = part[: len(out[r::Q])]
    return out


class Index:
    """The q-grams of normalised items: where each stands in which item."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE):
        every = [(i, normalised(t)) for i, t in items]
        kept = [(i, n) for i, n in every if len(n) >= Q] + [(i, n) for i, n in every if 0 < len(n) < Q]
        self.ids = [i for i, _ in kept]
        self.items = [n for _, n in kept]
        self.sizes = np.array([len(n) for n in self.items], dtype=np.int64)
        self.edits = np.where(self.sizes < MIN_ITEM, 0, np.minimum((self.sizes * rate).astype(np.int64), (self.sizes - Q) // Q))
        self.tiny: dict[bytes, list[int]] = {}
        for place, (_, n) in enumerate(kept):
            if len(n) < Q:
                self.tiny.setdefault(n.split(b" ", 1)[0], []).append(place)
        self.least = self.sizes + 1 - Q - self.edits * Q
        self.step = 2 * self.edits + 1
        codes = [grams(n) for n in self.items]
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.lexsort((place, item, flat))
        flat, item, place = flat[order], item[order], place[order]
        # Places of a q-gram in one item that lie a step apart or less touch all bands between them; such runs are one entry.
        new = np.ones(len(flat), dtype=bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.step[item[1:]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(flat))[: len(first)] - 1
        self.item, self.low, self.high = item[first], place[first], place[last]
        self.codes, self.first, self.count = np.unique(flat[first], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.codes * _ODD) >> np.uint64(64 - _BITS)] = True

    def candidates(self, texts: list[bytes]):
        """(text, item, band) that share enough q-grams; band ``b`` holds diagonals from ``b * step`` on, twice ``step`` wide."""
        if not len(self.codes):
            return np.zeros((0, 3), dtype=np.int64)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        code = grams(b"\0".join(texts))
        maybe = np.flatnonzero(self.seen[(code * _ODD) >> np.uint64(64 - _BITS)])
        at = np.searchsorted(self.codes, code[maybe])
        hit = self.codes[np.minimum(at, len(self.codes) - 1)] == code[maybe]
        at, pos = at[hit], maybe[hit]
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.count[at])
        done = 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + HITS, side="right")))
            for key in self.touched(at[done:upto], pos[done:upto], begin):
                merged, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, np.ones(len(key), np.int64)]), minlength=len(merged)).astype(np.int64)
                keys = merged
            done = upto
        key, n = keys, counts
        after = np.searchsorted(key, key + 1)
        after = np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), after, -1)
        before = np.full(len(key), -1)
        before[after[after >= 0]] = np.flatnonzero(after >= 0)
        item = (key >> 26) & ((1 << 18) - 1)
        own, down = n + np.where(after >= 0, n[after], 0), np.where(before >= 0, 0, n)
        found = [key[own >= self.least[item]], key[down >= self.least[item]] - 1]
        key = np.unique(np.concatenate(found))
        return np.column_stack([key >> 44, (key >> 26) & ((1 << 18) - 1), (key & ((1 << 26) - 1)) - 1])

    def touched(self, at: np.ndarray, pos: np.ndarray, begin: np.ndarray):
        """Keys (text, item, band) of the bands that the q-grams ``at`` of the positions touch, each band once for a position; about ``HITS`` at a time."""
        n = self.count[at]
        which = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos, item = np.repeat(pos, n), self.item[which]
        text = np.searchsorted(begin, pos, side="right") - 1
        # Diagonals start at 0 when the item starts its own length before the text does.
        diagonal = pos - begin[text] + self.sizes[item]
        least, most = (diagonal - self.high[which]) // self.step[item], (diagonal - self.low[which]) // self.step[item]
        head = (text << 44) | (item << 26) | (least + 1)
        more = most - least
        yield head
        step = 1
        while (more >= step).any():
            yield (head + step)[more >= step]
            step += 1

    def matches(self, texts: list[bytes]):
        """(text, item, distance, start, end) of verified matches; the best of each text and item."""
        best = {}
        for t, x in enumerate(texts) if self.tiny else ():
            for word in self.tiny.keys() & set(x.split(b" ")):
                best |= {(t, i): found for i in self.tiny[word] if (found := between_blanks(self.items[i], x))}
        for text, item, band in self.candidates(texts).tolist():
            k, m, step = int(self.edits[item]), int(self.sizes[item]), int(self.step[item])
            low = band * step - m
            begin, end = max(0, low - k), min(len(texts[text]), low + 2 * step + m + k)
            if m < MIN_ITEM:
                found, begin = between_blanks(self.items[item], texts[text]), 0
            else:
                found = aligned(self.items[item], texts[text][begin:end], k)
            if found:
                d, s, e = found[0], begin + found[1], begin + found[2]
                if (text, item) not in best or best[text, item] > (d, s, e):
                    best[text, item] = (d, s, e)
        return sorted((t, i, *x) for (t, i), x in best.items())


def between_blanks(item: bytes, text: bytes) -> tuple[int, int, int] | None:
    """The first place where the item stands as words of its own."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if text[at - 1 : at] in (b"", b" ") and text[end : end + 1] in (b"", b" "):
            return 0, at, end
        at = text.find(item, at + 1)
    return None


@lru_cache(maxsize=4096)
def aligned(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the item within the region, if it takes at most k edits."""
    at = region.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    d, end = banded(item, region, most=k)
    if d > k:
        return None
    _, back = banded(item[::-1], region[:end][::-1], anchored=True)
    return d, end - back, end


def banded(item: bytes, region: bytes, anchored: bool = False, most: int = 10**6) -> tuple[int, int]:
    """Least edits from the item to a part of the region, and where that part ends.

    Rows of the table run along the diagonals of the band, which is as wide as the region is longer than
    the item. ``anchored``: the part starts where the region does. The least of a row never falls from one row to
    the next, so a table ends as soon as it exceeds ``most``.
    """
    m = len(item)
    wide = max(len(region) - m, 0) + m // 5 + 2
    pad = m // 5 + 1
    text = np.zeros(m + wide + 2 * pad + 2, dtype=np.int16) - 1
    text[pad : pad + len(region)] = np.frombuffer(region, dtype=np.uint8)[: len(text) - pad]
    chars = np.frombuffer(item, dtype=np.uint8)
    width = wide + pad
    step = np.arange(width)
    row = np.where(step < pad, pad - step, step - pad if anchored else 0).astype(np.int64)
    for i in range(m):
        fresh = row + (text[i : i + width] != chars[i])
        fresh[:-1] = np.minimum(fresh[:-1], row[1:] + 1)
        row = np.minimum.accumulate(fresh - step) + step
        if i & 7 == 7 and row.min() > most:
            return most + 1, 0
    ends = m + step - pad
    row = np.where((ends >= 0) & (ends <= len(region)), row, 10**6)
    best = int(row.argmin())
    return int(row[best]), int(ends[best])


def places(text: str) -> np.ndarray:
    """For each byte of the text's normalised form the code point that it comes from."""
    low = text.lower()
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass").translate(_KEEP), dtype=np.uint8)
    lead = np.frombuffer(low.encode("utf-8", "surrogatepass"), dtype=np.uint8) & 0xC0 != 0x80
    of = np.cumsum(lead) - 1
    if len(low) != len(text):
        # Some letters have several code points in lower case.
        of = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])[of] if len(low) == sum(len(c.lower()) for c in text) else np.minimum(of, len(text) - 1)
    solid = raw != 32
    if not solid.any():
        return of[:0]
    first, last = np.flatnonzero(solid)[[0, -1]]
    # Of a run of blanks the last stands for the one that stays; blanks at the ends go.
    keep = solid.copy()
    keep[:-1] |= ~solid[:-1] & solid[1:]
    keep[:first] = False
    keep[last + 1 :] = False
    return of[keep]


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that the bytes start to end of its normalised form come from."""
    out = places(text)
    return (int(out[start]), int(out[min(end, len(out)) - 1]) + 1) if start < len(out) else (0, 0)


def chunked(texts):
    """Runs of normalised texts of about ``CHUNK`` bytes together (or one longer text), with the place of the first."""
    held, size, at = [], 0, 0
    for i, text in enumerate(texts):
        data = normalised(text)
        if held and (size + len(data) > CHUNK or len(held) >= 1 << 18):
            yield at, held
            held, size, at = [], 0, i
        held.append(data)
        size += len(data)
    if held:
        yield at, held


def blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> tuple[int, object]:
    """How many indexes the benchmark takes, and those, each of about ``most_bytes`` of text (and 100,000 items) at most."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, -(-(total or 0) // most_bytes), -(-n // 100_000))

    def made():
        for i in range(parts):
            own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
            yield Index(sorted(((r[0], r[1]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

    return parts, made()


HIT = "array<struct<item_id:long,edits:long,start:long,end:long>>"


def hits_of(index: Index, texts: list) -> list[list]:
    """The hits of each text."""
    out = [[] for _ in texts]
    for at, part in chunked(texts):
        for t, i, d, s, e in index.matches(part):
            s, e = original_span(texts[at + t], s, e)
            out[at + t].append({"item_id": index.ids[i], "edits": d, "start": s, "end": e})
    return out


def hits_by_block(rows: DataFrame, indexes) -> DataFrame:
    """``rid`` and ``hits`` of the rows ``(rid, text)`` with any, one pass for each index; only hits are stored."""
    found = []
    for index in indexes:
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for pdf in batches:
                hits = hits_of(shared.value, pdf["text"].tolist())
                hit = [bool(h) for h in hits]
                yield pd.DataFrame({"rid": pdf["rid"][hit], "hits": pd.Series([h for h in hits if h], index=pdf["rid"][hit].index, dtype=object)})

        found.append(stored(rows.select("rid", "text").mapInPandas(run, f"rid long, hits {HIT}"), "hits"))
        shared.unpersist()
    return reduce(DataFrame.union, found).groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col`` and ``hits`` of every document: item_id, edits and the matched code points (start, end)."""
    parts, indexes = blocks(benchmark, most_bytes)
    if parts > 1:
        rows = with_order(docs, id_col, text_col)
        found = rows.select("rid", "id").join(hits_by_block(rows, indexes), "rid", "left")
        return found.select(F.col("id").alias(id_col), F.coalesce("hits", F.array().cast(HIT)).alias("hits"))
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(next(indexes))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "hits": hits_of(shared.value, pdf["text"].tolist())})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, hits {HIT}").select(F.col("id").alias(id_col), "hits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a match, with all their columns."""
    parts, indexes = blocks(benchmark, most_bytes)
    if parts > 1:
        rows = with_order(docs, id_col, text_col, docs.columns)
        clean = rows.join(hits_by_block(rows, indexes).select("rid"), "rid", "left_anti")
        return clean.select(*[F.col(f"other.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    shared = docs.sparkSession.sparkContext.broadcast(next(indexes))
    place = docs.columns.index(text_col)

    def run(batches):
        for pdf in batches:
            keep = np.ones(len(pdf), dtype=bool)
            for at, part in chunked(pdf.iloc[:, place].tolist()):
                for t, *_ in shared.value.matches(part):
                    keep[at + t] = False
            yield pdf[keep]

    return docs.mapInPandas(run, docs.schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.sort_array(F.col("hits.item_id")).alias("item_ids"), F.col("hits"))
