"""Removal of repeated byte strings by distributed bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier.

1. Initial buckets. Of the ``LENGTH - Q + 1`` q-grams of each string the one with the least hash is its
   anchor (the first of equals). Equal strings have equal anchors at equal places, so they stand in the bucket of one q-gram, and
   only anchors are shuffled, one for about 35 bytes. Strings next to one another with one anchor form a stretch. Buckets of one stretch end here.
2. The other stretches are refined where their text is: :func:`suffixes` sorts buckets on the bucket pointers
   of later offsets. Of equal stretches the first stays for all and the others are found to be later, so a passage in a
   third of all texts leaves one stretch for each batch.
3. The stretches that stay meet in the task of their bucket. They are refined once more, first from their starts on, which finds those equal
   throughout, and then, where a bucket still holds several, from each of their strings on. A bucket of more than ``HOT`` stretches is first cut into cells of ``CELL`` strings, whose buckets are all that
   their strings share, and then into single strings, so it spreads over tasks.

Hashes only deal stretches out to tasks; which strings are equal is read off the buckets of the refined order.

Defined results: null and empty texts keep nothing and lose nothing; texts under ``LENGTH`` bytes lose
nothing; long texts are read whole; rows that repeat an id, or have none, count as documents of their own,
ordered by id (nulls first) and then by text, and of equal rows all but one count as later; an empty table gives
no rows. Only ``id_col``, ``text_col`` and the columns to carry are read.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import discard, read, stored, with_order

LENGTH = 100
Q = 32
#: Bytes of the first buckets inside a task.
GRAM = 8
#: Bytes that are refined together, and slots of the order that one block of buckets has.
CHUNK = 1 << 20
SLOTS = 1 << 15
#: Texts that numpy cuts into stretches at a time, in bytes.
CUT = 1 << 16
#: Strings of a cell, and stretches of the largest bucket that one task takes whole.
CELL = 9
HOT = 20_000
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BASE64 = np.uint64(_BASE)


@lru_cache(maxsize=8)
def powers(bits: int, base: int) -> np.ndarray:
    """The first ``2 ** bits`` powers of ``base``, modulo 2 ** 64."""
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of some bytes, from running sums of weighted bytes."""

    def __init__(self, data: np.ndarray):
        bits = max(16, int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(bits, _BASE)[: len(data)], out=self.sums[1:])
        self.back = powers(bits, _BACK)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        """As :meth:`all`, at some places only."""
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def all(self, length: int) -> np.ndarray:
        """The hashes, unmixed, of all substrings of one length: good in their upper bits."""
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of the least by its upper half, the first of equals."""
    low = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    n, have = len(x) - width + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunks(texts, most: int = CUT):
    """Index ranges of texts of ``most`` bytes together, and their bytes; a longer text stands alone."""
    at, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > most:
            yield at, held
            at, size, held = i, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield at, held


def stretches(texts: list[bytes], length: int = LENGTH, q: int = Q):
    """The stretches of some texts: (text, bucket, first string, strings, anchor's distance), in order of the strings."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    if not n.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none, none
    roll = Rolling(np.frombuffer(b"".join(texts), dtype=np.uint8)).all(q)
    at = least_in_windows(roll, length - q + 1)
    cut = np.empty(len(at) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    np.not_equal(at[1:], at[:-1], out=cut[1:-1])
    for edge in (begin, begin + n):
        cut[edge[edge < len(at)]] = True
    first = np.flatnonzero(cut)
    count, first = np.diff(first), first[:-1]
    owner = np.searchsorted(begin, first, side="right") - 1
    inside = first < begin[owner] + n[owner]
    first, count, owner = first[inside], count[inside], owner[inside]
    place = at[first]
    return owner, roll[place], first - begin[owner], count, place - first


def grams(data: np.ndarray, at: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The ``gram`` bytes from each place on as a number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(GRAM, dtype=np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, GRAM)
    return np.ascontiguousarray(windows[at]).view(">u8")[:, 0].astype(np.uint64) >> np.uint64(8 * (GRAM - gram))


def suffixes(word: np.ndarray, wanted: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the words that start there, and the pointer of each to its bucket; ``wanted`` has a flag for each place.

    Bucket-pointer refinement. A pointer names the first slot of a place's bucket. Buckets are first those of the places' words,
    which are q-grams. Block after block of neighbouring buckets is sorted on the pointers ``step``, ``2 * step`` and so on
    places later, until all in a bucket agree as far as ``depth``; buckets that split are cut at once, their new pointers
    are written back, and the offsets and blocks that follow read them. Pointers only get finer, in the order of the words, so
    places that agree that far end up side by side. Buckets with less than two wanted places stay as they are.
    """
    n = len(wanted)
    order = np.argsort(word[:n], kind="stable")
    head = np.concatenate([[True], word[order[1:]] != word[order[:-1]]])
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, n))
    bucket = np.repeat(starts, sizes)
    pointer = np.full(len(word) + step, -1, dtype=np.int64)
    pointer[order] = bucket
    open_ = np.add.reduceat(wanted[order].astype(np.int64), starts) > 1
    crowded = np.flatnonzero(np.repeat(open_, sizes))
    filled = np.cumsum(sizes[open_])
    for slots in np.split(crowded, filled[:-1][np.diff(filled // SLOTS) > 0]):
        refine(slots, bucket, order, pointer, step, depth)
    return order, pointer


def refine(slots: np.ndarray, bucket: np.ndarray, order: np.ndarray, pointer: np.ndarray, step: int, depth: int) -> None:
    """Sorts the buckets that ``slots`` hold until each agrees as far as ``depth``; writes ``order`` and ``pointer``."""
    own = bucket[slots]
    for k in range(step, depth, step):
        key = pointer[order[slots] + k]
        edge = own[1:] != own[:-1]
        splits = ~edge & (key[1:] != key[:-1])
        if not splits.any():
            continue
        run = np.concatenate([[0], np.cumsum(edge)])
        torn = np.zeros(run[-1] + 1, dtype=bool)
        torn[run[1:][splits]] = True
        part = np.flatnonzero(torn[run])
        both = own[part] << 32 | (key[part] + 1)
        turn = np.argsort(both, kind="stable")
        both = both[turn]
        places = order[slots[part]][turn]
        fresh = np.maximum.accumulate(np.where(np.concatenate([[True], both[1:] != both[:-1]]), slots[part], 0))
        order[slots[part]] = places
        pointer[places] = own[part] = fresh
        lone = np.concatenate([[True], own[1:] != own[:-1]])
        lone &= np.concatenate([lone[1:], [True]])
        slots, own = slots[~lone], own[~lone]
        if not len(slots):
            return


def not_first(kind: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` places those that are not the first of their kind; equal kinds stand side by side."""
    later = np.zeros(n, dtype=bool)
    if len(kind):
        heads = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        first = np.repeat(np.minimum.reduceat(places, heads), np.diff(np.append(heads, len(kind))))
        later[places] = places != first
    return later


def later_strings(data: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings that start at the given places (in order) also start at an earlier one of them."""
    gram = min(GRAM, length)
    word = np.concatenate([grams(data, np.arange(len(data)), gram), np.zeros(length, dtype=np.uint64)])
    wanted = np.zeros(len(data), dtype=bool)
    wanted[strings] = True
    order, _ = suffixes(word, wanted, gram, length)
    order = order[wanted[order]]
    same = np.zeros(len(order), dtype=bool)
    open_ = np.arange(1, len(order))
    for k in (*range(0, length - gram, gram), length - gram):
        open_ = open_[word[order[open_ - 1] + k] == word[order[open_] + k]]
    same[open_] = True
    return not_first(np.cumsum(~same), order, len(data))[strings]


def later_pieces(data: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which pieces (``size`` bytes from ``at``, their anchor ``left`` bytes on) are equal to an earlier one.

    Refined as :func:`later_strings`, but only at every eighth byte of a piece: its places are a word for size and anchor, then
    its q-grams side by side, the last one reaching back so that it ends with the piece.
    """
    n = -(-size // GRAM) + 1
    begin = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(begin, n)
    of = np.repeat(np.arange(len(n)), n)
    place = at[of] + np.clip(np.minimum((step - 1) * GRAM, size[of] - GRAM), 0, None)
    depth = int(n.max())
    word = grams(data, place) >> (8 * np.maximum(GRAM - size[of], 0)).astype(np.uint64)
    word = np.concatenate([word, np.zeros(depth, dtype=np.uint64)])
    word[begin] = (size << 8 | left).astype(np.uint64)
    order, _ = suffixes(word, step == 0, 1, depth)
    order = order[step[order] == 0]
    same = np.zeros(len(order), dtype=bool)
    open_ = np.arange(1, len(order))
    for k in range(depth):
        one, two = order[open_ - 1], order[open_]
        open_ = open_[(word[one + k] == word[two + k]) | (k >= n[of[two]])]
    same[open_] = True
    return not_first(np.cumsum(~same), of[order], len(n))


def packed(first, count, left):
    """A stretch as a long: its first string, how many there are, and how far after its start the anchor stands."""
    return first << 16 | count << 8 | left


def unpacked(place):
    return place >> 16, place >> 8 & 255, place & 255


def span(start, end):
    return start << 32 | end


PIECES = "bucket long, rid long, place long, bytes binary, span long"


def cut_out(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after another, and where each range begins among them."""
    begin = np.cumsum(size) - size
    return flat[np.arange(size.sum()) + np.repeat(start - begin, size)], begin


def sent(bucket, rid, first, count, left, flat, at, length) -> pd.DataFrame:
    """Stretches (bytes of ``flat`` from ``at`` on, in the order of their texts) as ``PIECES``; those equal to an earlier one are spans."""
    data, begin = cut_out(flat, at, count + length - 1)
    later = later_pieces(data, begin, count + length - 1, left)
    size = count + length - 1
    raw = data.tobytes()
    piece = [None if x else raw[b : b + s] for x, b, s in zip(later.tolist(), begin.tolist(), size.tolist())]
    gone = pd.arrays.IntegerArray(span(first, first + size), ~later)
    return pd.DataFrame({"bucket": bucket, "rid": rid, "place": packed(first, count, left), "bytes": piece, "span": gone})


def pieces_of(rows: list, length: int, q: int) -> pd.DataFrame:
    """The wanted stretches of some (rid, text, places) as ``PIECES``."""
    rows = sorted(rows, key=lambda r: r[0])
    texts = [np.frombuffer(r[1].encode("utf-8", "surrogatepass"), dtype=np.uint8) for r in rows]
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    first, count, left = unpacked(np.sort(np.concatenate([np.asarray(r[2], dtype=np.int64) + (b << 16) for r, b in zip(rows, begin)])))
    flat = np.concatenate(texts)
    bucket = Rolling(flat).at(first + left, q).view(np.int64)
    rid = np.array([r[0] for r in rows], dtype=np.int64)[owner]
    return sent(bucket, rid, first - begin[owner], count, left, flat, first, length)


def joined(rows: list):
    """(rid, first, count, left, bytes, where each begins) of some pieces."""
    rid, place = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2))
    flat = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    return rid, *unpacked(place), flat, np.cumsum([0, *(len(r[3]) for r in rows)])[:-1]


def finer(rows: list, length: int, q: int, width: int) -> pd.DataFrame:
    """Pieces cut where the anchor's distance is a multiple of ``width``; a cut's bucket is what all its strings share."""
    rid, first, count, left, flat, begin = joined(sorted(rows, key=lambda r: (r[1], r[2])))
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(np.arange(len(rows)), count)
    cell = (left[of] - step) // width
    head = np.flatnonzero((step == 0) | np.concatenate([[True], cell[1:] != cell[:-1]]))
    n, of, step, cell = np.diff(np.append(head, len(cell))), of[head], step[head], cell[head]
    anchor = begin[of] + left[of]
    far = np.minimum((cell + 1) * width - 1, length - q)
    bucket = mixed(Rolling(flat).of(anchor - cell * width, anchor - far + length) + cell.astype(np.uint64))
    return sent(bucket.view(np.int64), rid[of], first[of] + step, n, left[of] - step, flat, begin[of] + step, length)


def repeats_of(rows: list, length: int) -> pd.DataFrame:
    """Spans of strings that also start earlier, for pieces of whole buckets, in the order of buckets and texts."""
    rid, first, count, left, flat, begin = joined(rows)
    later = later_pieces(flat, begin, count + length - 1, left)
    gone = [(rid[later], span(first[later], (first + count)[later] + length - 1))]
    bucket = np.cumsum([False, *(a[0] != b[0] for a, b in zip(rows, rows[1:]))])
    open_ = np.flatnonzero(~later & (np.bincount(bucket[~later], minlength=len(rows))[bucket] > 1))
    if len(open_):
        rid, first, count = rid[open_], first[open_], count[open_]
        data, at = cut_out(flat, begin[open_], count + length - 1)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        of = np.repeat(np.arange(len(count)), count)
        later = later_strings(data, at[of] + step, length)
        turn = np.flatnonzero(np.concatenate([[True], (later[1:] != later[:-1]) | (step[1:] == 0)]))
        n = np.diff(np.append(turn, len(later)))[later[turn]]
        turn = turn[later[turn]]
        start = first[of[turn]] + step[turn]
        gone.append((rid[of[turn]], span(start, start + n + length - 1)))
    return pd.DataFrame({"rid": np.concatenate([x[0] for x in gone]), "span": np.concatenate([x[1] for x in gone])})


def gathered(rows, size, most: int = CHUNK):
    """Lists of rows that have ``most`` bytes together by ``size`` of a row."""
    held, have = [], 0
    for row in rows:
        held.append(row)
        have += size(row)
        if have > most:
            yield held
            held, have = [], 0
    if held:
        yield held


def repeated_spans(docs: DataFrame, dealt: DataFrame, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """``rid`` and ``spans``: runs of bytes (start and end packed in a long) covered by strings that start earlier.

    ``docs`` has ``rid`` and ``text``; ``dealt`` is the same dealt out by ``rid``.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def anchors(batches):
        for pdf in batches:
            rids, out = pdf["rid"].to_numpy(), []
            for at, texts in chunks(pdf["text"]):
                owner, bucket, first, count, left = stretches(texts, length, q)
                out.append((bucket.view(np.int64), rids[at + owner], packed(first, count, left)))
            if out:
                bucket, rid, place = map(np.concatenate, zip(*out))
                # One row of each bucket counts for all of its batch; the others are known to have company.
                _, lead, times = np.unique(bucket, return_index=True, return_counts=True)
                n = np.zeros(len(bucket), dtype=np.int64)
                n[lead] = times
                yield pd.DataFrame({"bucket": bucket, "rid": rid, "place": place, "n": n})

    def pieces(batches):
        rows = (row for pdf in batches for row in zip(pdf["rid"], pdf["text"], pdf["places"]))
        for some in gathered(rows, lambda r: len(r[2]) * 2 * length):
            yield pieces_of(some, length, q)

    def met(batches):
        rows = (row for pdf in batches for row in zip(pdf["bucket"], pdf["rid"], pdf["place"], pdf["bytes"]))
        buckets = (list(some) for _, some in groupby(rows, key=itemgetter(0)))
        for some in gathered((b for b in buckets if len(b) > 1), lambda b: len(b) * 2 * length):
            yield repeats_of([row for one in some for row in one], length)

    def crowded_places():
        """The places of stretches whose bucket holds others, by ``rid``."""
        found = stored(docs.mapInPandas(anchors, "bucket long, rid long, place long, n long"), "anchors")
        leads = found.filter("n > 0")
        crowded = leads.groupBy("bucket").agg(F.sum("n").alias("_n")).filter("_n > 1").select("bucket")
        both = leads.join(crowded, "bucket").select("rid", "place").union(found.filter("n = 0").select("rid", "place"))
        out = stored(both.groupBy("rid").agg(F.collect_list("place").alias("places")), "wanted")
        discard(found)
        return out

    wanted = crowded_places()
    rows = stored(dealt.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "places").mapInPandas(pieces, PIECES), "pieces")
    discard(wanted)
    made = [rows]
    spans = [rows.filter("span is not null").select("rid", "span")]
    for width in (CELL, 1, None):
        here = rows.filter("span is null").drop("span")
        crowds = stored(here.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("bucket"), "crowds")
        more = width is not None and not crowds.isEmpty()
        calm = here.join(crowds, "bucket", "left_anti") if more else here
        calm = calm.repartition(parts, "bucket").sortWithinPartitions("bucket", "rid", "place")
        spans.append(calm.mapInPandas(met, "rid long, span long"))
        if not more:
            break

        def cells(batches, width=width):
            every = (row for pdf in batches for row in zip(pdf["bucket"], pdf["rid"], pdf["place"], pdf["bytes"]))
            for some in gathered(every, lambda r: 2 * len(r[3]) if width > 1 else length * (len(r[3]) - length + 1)):
                yield finer(some, length, q, width)

        rows = stored(here.join(crowds, "bucket", "left_semi").mapInPandas(cells, PIECES), "pieces")
        made.append(rows)
        spans.append(rows.filter("span is not null").select("rid", "span"))
    out = stored(reduce(DataFrame.union, spans).groupBy("rid").agg(F.collect_set("span").alias("spans")), "spans")
    for table in made:
        discard(table)
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, list]:
    """The bytes that no run covers, and the maximal runs covered."""
    if not runs:
        return data, []
    turn = np.zeros(len(data) + 1, dtype=np.int64)
    bounds = np.array(runs)
    np.add.at(turn, bounds[:, 0], 1)
    np.add.at(turn, bounds[:, 1], -1)
    gone = np.cumsum(turn[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), edge.reshape(-1, 2).tolist()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """Per document its id, the bytes kept, the removed runs as (start, end) of the input's bytes, and the columns to carry."""
    carry = carry or []
    rows = with_order(docs, id_col, text_col, carry)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "rid")
    found = repeated_spans(rows.select("rid", "text"), dealt, length, q, hot)

    def apply(batches):
        for pdf in batches:
            for at, texts in chunks(pdf["text"]):
                runs = [[] if x is None else [(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in x] for x in pdf["spans"].iloc[at : at + len(texts)]]
                out = [cut(data, own) for data, own in zip(texts, runs)]
                yield pd.DataFrame({"id": pdf["id"].iloc[at : at + len(texts)].to_numpy(), "kept": [x[0] for x in out], "removed": [x[1] for x in out], "other": pdf["other"].iloc[at : at + len(texts)].to_numpy()})

    kind = docs.schema[id_col].dataType.simpleString()
    joined = dealt.join(found.hint("shuffle_hash"), "rid", "left").select("id", "text", "other", "spans")
    other = joined.schema["other"].dataType.simpleString()
    out = joined.mapInPandas(apply, f"id {kind}, kept binary, removed array<array<long>>, other {other}")
    return out.select(F.col("id").alias(id_col), "kept", "removed", *[F.col(f"other.c{i}").alias(c) for i, c in enumerate(carry)])


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    out = drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return out.select(
        "doc_id",
        (F.octet_length("kept") + lost).cast("long").alias("n_bytes"),
        lost.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
