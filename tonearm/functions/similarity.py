"""String similarity by longest common subsequences, for Arrow batches and for plain SQL plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


#: Pairs whose rows are moved on together, and the most letters of the shorter string of such a pair.
LANES, WORD = 4096, 64


def letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings as rows padded with -1, and the strings' lengths."""
    sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    out = np.full((len(names), int(sizes.max(initial=0))), -1, dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """:func:`common_length` of each pair; the rows of many pairs are moved on together, one letter of the longer strings at a time."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right)]
    out = np.zeros(len(pairs), dtype=np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order and len(pairs[order[-1]][0]) > WORD:
        out[order[-1]] = common_length(*pairs[order.pop()])
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        wide = [i for i in some if len(pairs[i][0]) > WORD]
        out[wide] = [common_length(*pairs[i]) for i in wide]
        some = [i for i in some if 0 < len(pairs[i][0]) <= WORD]
        if not some:
            continue
        short, sizes = letters([pairs[i][0] for i in some])
        long_, _ = letters([pairs[i][1] for i in some])
        alphabet = np.unique(short[short >= 0])
        rows = np.arange(len(some))
        masks = np.zeros((len(some), len(alphabet) + 1), dtype=np.uint64)
        for k in range(short.shape[1]):
            here = np.nonzero(short[:, k] >= 0)[0]
            masks[here, np.searchsorted(alphabet, short[here, k])] |= np.uint64(1 << k)
        place = np.minimum(np.searchsorted(alphabet, long_), len(alphabet) - 1)
        place[alphabet[place] != long_] = len(alphabet)
        full = np.where(sizes == WORD, np.uint64(2**64 - 1), (np.uint64(1) << sizes.astype(np.uint64) % np.uint64(WORD)) - np.uint64(1))
        row = full.copy()
        for k in range(long_.shape[1]):
            hit = row & masks[rows, place[:, k]]
            row = ((row + hit) | (row - hit)) & full
        out[some] = sizes - np.bitwise_count(row)
    return out


#: Names whose rows are moved on together where all meet all.
BLOCK = 16384


class Names:
    """Names ordered by length, at most ``BLOCK``, ready to be met by any string: for each letter where it stands in each name, and how often."""

    def __init__(self, names: list[str]):
        self.names = sorted(names, key=len)
        flat, self.sizes = letters(self.names)
        longest = flat.shape[1]
        kind = np.uint32 if longest <= 32 else np.uint64
        bits = 8 * np.dtype(kind).itemsize
        words = max(1, -(-longest // bits))
        alphabet = np.unique(flat[flat >= 0])
        self.at = np.zeros((len(alphabet), words, len(names)), dtype=kind)
        self.counts = np.zeros((len(alphabet), len(names)), dtype=np.uint16 if longest > 255 else np.uint8)
        for k in range(longest):
            here = np.nonzero(flat[:, k] >= 0)[0]
            code = np.searchsorted(alphabet, flat[here, k])
            self.at[code, k // bits, here] |= kind(1 << k % bits)
            self.counts[code, here] += 1
        self.place = {chr(c): i for i, c in enumerate(alphabet.tolist())}
        self.full = np.zeros((words, len(names)), dtype=kind)
        for w in range(words):
            held = np.clip(self.sizes - w * bits, 0, bits)
            self.full[w] = np.where(held == bits, kind(2**bits - 1), (kind(1) << (held % bits).astype(kind)) - kind(1))

    def bound(self, other: str, at: slice) -> np.ndarray:
        """The number of letters that ``other`` shares with each name in any order: no common subsequence is longer."""
        top, counts = np.iinfo(self.counts.dtype).max, self.counts
        out = np.zeros(len(range(*at.indices(len(self.names)))), dtype=np.int32 if len(other) > 255 else np.uint8)
        for c in set(other):
            if c in self.place:
                out += np.minimum(counts[self.place[c], at], counts.dtype.type(min(other.count(c), top))).astype(out.dtype, copy=False)
        return out

    def common(self, other: str, at: slice | np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of ``other`` and the names at the given places."""
        full = self.full[:, at]
        seen = {c: self.at[self.place[c]][:, at] for c in set(other) if c in self.place}
        row, hit, kept = full.copy(), np.empty_like(full), np.empty_like(full)
        for c in other:
            if c not in seen:
                continue
            np.bitwise_and(row, seen[c], out=hit)
            np.subtract(row, hit, out=kept)
            if len(full) == 1:
                np.add(row, hit, out=row)
            else:
                carry = np.zeros(full.shape[1], dtype=full.dtype)
                for w in range(len(full)):
                    first = row[w] + hit[w]
                    total = first + carry
                    carry = ((first < hit[w]) | (total < first)).astype(full.dtype)
                    row[w] = total
            np.bitwise_or(row, kept, out=row)
        np.bitwise_and(row, full, out=row)
        return self.sizes[at] - np.bitwise_count(row).sum(axis=0, dtype=np.int64)

    def meet(self, other: str, at: slice, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places within ``at`` whose names have ``least`` letters or more in common with ``other``, in order, and how many."""
        kept = np.nonzero(self.bound(other, at) >= least)[0]
        if not len(kept):
            return kept, kept
        # Half of the names cost as much picked as all of them read in place.
        if 2 * len(kept) > len(least):
            found = self.common(other, at)[kept]
        else:
            found = self.common(other, kept + at.start)
        good = found >= least[kept]
        return kept[good] + at.start, found[good]


def blocks(names: list[str]) -> list[tuple[int, Names]]:
    """``names``, which come by length, as :class:`Names` of some 64 MB at most, each with the place of its first name."""
    cells = max(1, len(set().union(*names))) * (max(map(len, names), default=0) // 64 + 1)
    size = max(256, min(BLOCK, 8_000_000 // cells))
    return [(at, Names(names[at : at + size])) for at in range(0, len(names), size)]


def ratio_from(block: Names, other: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the names whose ratio with ``other`` reaches ``least``, and their ratios."""
    n, share = len(other), least / (200.0 - least)
    low = int(np.searchsorted(block.sizes, n * share - 1e-6))
    high = int(np.searchsorted(block.sizes, n / share + 1e-6, "right")) if share > 0 else len(block.names)
    need = np.ceil(least * (block.sizes[low:high] + n) / 200.0 - 1e-9)
    at, common = block.meet(other, slice(low, high), need)
    total = block.sizes[at] + n
    score = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
    return at[score >= least], score[score >= least]


def part_from(block: Names, other: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the names whose partial ratio with ``other`` reaches ``least``, and these ratios.

    Names more than ``200 / least`` times as long as the others only where the shorter one has a blank, as :func:`~tonearm.operators.matching.safe_partial` lowers the rest.
    """
    n, sizes = len(other), block.sizes
    wide = int(np.searchsorted(sizes, n * least / 200.0 - 1e-6))
    low = 0 if any(" " in x for x in block.names[:wide]) else wide
    high = len(sizes) if " " in other else int(np.searchsorted(sizes, n * 200.0 / least + 1e-6, "right"))
    # A window's ratio doesn't exceed that of one as long as all that both have in common, and alike throughout.
    need = np.ceil(least * np.minimum(sizes[low:high], n) / (200.0 - least) - 1e-9)
    at, _ = block.meet(other, slice(low, high), np.maximum(need, 1))
    at = np.array([i for i in at if i >= wide or " " in block.names[i]], dtype=np.int64)
    score = np.array([best_window(block.names[i], other) for i in at], dtype=np.float64)
    return at[score >= least], score[score >= least]


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    sizes = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.int64)
    return np.where(sizes > 0, 200.0 * common_lengths(left, right) / np.maximum(sizes, 1), 100.0)


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([best_window(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def partial_from_udf(least: float):
    """The partial ratio, or null where the strings have too few letters in common for any window to reach ``least``, so that no window is read.

    A window's ratio doesn't exceed that of one as long as all that both have in common, and alike throughout. Filters on it stay above it, so it is computed once.
    """

    @F.pandas_udf(DoubleType())
    def partial(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right = a.fillna("").tolist(), b.fillna("").tolist()
        common, short = common_lengths(left, right), np.array([min(len(x), len(y)) for x, y in zip(left, right)], dtype=np.int64)
        near = (200.0 * common >= least * (short + common) - 1e-9) & (short > 0)
        return pd.Series([best_window(x, y) if n else None for x, y, n in zip(left, right, near)], dtype="float64")

    return partial.asNondeterministic()


#: :func:`ratio_udf`, computed once where its value is both filtered and kept.
ratio_once_udf = F.pandas_udf(lambda a, b: pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64"), DoubleType()).asNondeterministic()


def best_window(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of the longer, shorter ones at its edges.

    All windows are read in one pass: each has its own lane of bits in one large number, wide enough that no lane's carry reaches the next,
    and the letters that windows meet next are the lanes of the longer string's letters, moved on by one.
    """
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n, m = len(short), len(long_)
    size = n // 8 + 1
    at: dict[str, int] = {}
    for i, c in enumerate(short):
        at[c] = at.get(c, 0) | 1 << i
    lanes = m + n - 1
    marks = int.from_bytes(b"".join(at.get(c, 0).to_bytes(size, "little") for c in long_), "little")
    full = int.from_bytes(((1 << n) - 1).to_bytes(size, "little") * lanes, "little")
    row = full
    for k in range(n - 1, -1, -1):
        hit = row & marks << 8 * size * k
        row = ((row + hit) | (row - hit)) & full
    left = np.bitwise_count(np.frombuffer(row.to_bytes(size * lanes, "little"), dtype=np.uint8)).reshape(lanes, size).sum(axis=1, dtype=np.int64)
    end = np.arange(lanes)
    seen = np.minimum(end, m - 1) - np.maximum(end - n + 1, 0) + 1
    return float((200.0 * (n - left) / (n + seen)).max())


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio_udf(sorted_tokens(a), sorted_tokens(b))


def release_score(artist_a: Column, title_a: Column, artist_b: Column, title_b: Column) -> Column:
    """Two parts artist, three parts title."""
    return 0.4 * token_sort_ratio(artist_a, artist_b) + 0.6 * token_sort_ratio(title_a, title_b)
