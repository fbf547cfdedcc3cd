"""Language-model scores by Brown class bigrams.

Every token belongs to a class. Exchange clustering forms the classes: first the ``SEEDS`` most frequent words are moved one
by one to wherever the likelihood of the class bigrams gains most. Then the ``HEAD`` most frequent words, and the words beyond together with all that share
their last two bytes, are exchanged in rounds: tasks propose for each the class in which it gains most, by how often which classes
stand before and after it in all training texts, and the driver applies the proposals as long as the likelihood rises. The bigrams of these units are counted once and kept
sparse, over tasks; the driver holds one class for each unit and the table of class bigrams. The number of classes grows with the vocabulary. A text's probability is the product of class transitions,
``P(class | class before)``, and emissions, ``(c + 0.5) / (tokens of the class + 0.5 * (words of the class + 1))``,
so every class keeps the mass of one unseen word. Word counts, contexts, class sizes and transitions cover all training
texts; bounded are only the words that a task holds one by one.

What a text holds of words beyond the ``HEAD`` most frequent meets its counts in a join on the word. Counts are combined within tasks first.
Texts are read in three passes: word counts, bigrams, scores.

Defined results: null and empty texts are one end token; long texts are read whole; repeated rows are scored
alike and each counts in training; a null id is in no fold: it is neither held out nor learnt from; without any
training text all counts are 0 and every token has the mass of an unseen word; an empty table gives no rows.
Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import discard, fold, read, stored

#: Words that the driver moves one by one, how often it goes through them, and the most classes.
SEEDS = 1200
SWEEPS = 4
#: Rounds in which all units may move, after the first one, which gives classes to those that the driver didn't move.
ROUNDS = 1
#: Bigrams of units that are stored as one row.
PACKED = 1 << 16
MOST_CLASSES = 256
#: The most words whose counts every task holds.
HEAD = 200_000
#: Distinct words that a task counts before it hands its counts on.
HELD = 400_000
#: Stands for the end of a text; no word holds white space.
END = b"\n"
SMOOTH = 20.0


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (binary) and ``n`` over all texts of ``docs(text)``."""

    def run(batches):
        held = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                held.update(tokens(text))
            held[END] += len(pdf)
            if len(held) > HELD:
                yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

    return docs.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count) of those at least as frequent as the highest count that leaves no more than ``most`` of them, by frequency."""
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).toArrow()
    total, least = 0, None
    for n, words in zip(levels["n"].to_pylist(), levels["words"].to_pylist()):
        total += words
        if total > most:
            break
        least = n
    if least is None:
        return []
    found = counts.filter(F.col("n") >= least).toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist()), key=lambda r: (-r[1], r[0]))


class Units:
    """Numbers of what is clustered: 0 the end, 1 what no other number stands for, then head words by frequency, then endings of two bytes."""

    def __init__(self, head: list[bytes], endings: list[bytes]):
        self.words = {END: 0} | {w: i for i, w in enumerate(head, 2)}
        self.endings = {w: i for i, w in enumerate(endings, 2 + len(head))}
        self.size = 2 + len(head) + len(endings)

    def of(self, words: list[bytes]) -> np.ndarray:
        get, end = self.words.get, self.endings.get
        return np.array([x if (x := get(w)) is not None else end(w[-2:], 1) for w in words], dtype=np.int64)

    def pairs(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The units of a text's tokens and those before them; a text starts after an end."""
        seq = self.of(tokens(text))
        return np.concatenate([[0], seq]), np.concatenate([seq, [0]])


def key_counts(docs: DataFrame, keys) -> DataFrame:
    """``key`` and ``n``: how often the numbers that ``keys(text)`` gives occur, counted some texts at a time."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                key, n = np.unique(np.concatenate([keys(t) for t in pdf["text"].iloc[at : at + 2048]]), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    return docs.mapInPandas(run, "key long, n long")


def table_of(rows: DataFrame, size: int) -> np.ndarray:
    """Counts whose keys are ``row * size + column`` as a matrix."""
    found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(table: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each word of a table of bigrams; word 0, the end, keeps class 0 for itself.

    Starts with words dealt out by frequency; each sweep moves every word to the class that gains most.
    """
    size = len(table)
    freq = table.sum(0) + table.sum(1)
    order = np.argsort(-freq[1:], kind="stable") + 1
    cls = np.zeros(size, dtype=np.int64)
    cls[order] = 1 + np.arange(size - 1) % max(1, classes - 1)
    k = max(2, classes)
    onehot = np.eye(k)
    by_row = table @ onehot[cls]  # word by class that follows
    by_col = table.T @ onehot[cls]  # word by class before
    n = onehot[cls].T @ by_row
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                continue
            old, own = cls[w], table[w, w]
            r, c = by_row[w].copy(), by_col[w].copy()
            r[old] -= own
            c[old] -= own
            n[old] -= r
            n[:, old] -= c
            n[old, old] -= own
            base_row, base_col = n.sum(1), n.sum(0)
            wr, wc = r.sum() + own, c.sum() + own
            # Row and column of each class with the word added; their crossing counts once.
            gain = (_f(n + r) - _f(n)).sum(1) + (_f(n + c[:, None]) - _f(n)).sum(0)
            d = np.diag(n)
            gain += _f(d + r + c + own) - _f(d) - (_f(d + r) - _f(d)) - (_f(d + c) - _f(d))
            gain -= _f(base_row + wr) - _f(base_row) + _f(base_col + wc) - _f(base_col)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            n[new] += r
            n[:, new] += c
            n[new, new] += own
            if new != old:
                moved += 1
                by_row[:, old] -= table[:, w]
                by_row[:, new] += table[:, w]
                by_col[:, old] -= table[w]
                by_col[:, new] += table[w]
                cls[w] = new
        if not moved:
            break
    return cls


def contexts_of(train: DataFrame, shared) -> DataFrame:
    """How often ``other`` stands before (side 0) or after (1) each unit: rows of up to ``PACKED`` such counts, sorted by unit, as four packed columns."""
    size, parts = shared.value.size, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(text):
        before, after = shared.value.pairs(text)
        return before * size + after

    found = stored(key_counts(train, pairs).groupBy("key").agg(F.sum("n").alias("n")), "bigrams")
    before, after = F.expr(f"int(key div {size})"), F.expr(f"int(key % {size})")
    rows = found.select(after.alias("unit"), (before * 2).alias("other"), "n").union(found.select(before, after * 2 + 1, "n"))

    def pack(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def packed(held):
        whole = pd.concat(held)
        unit, other, n = whole["unit"].to_numpy(np.int32), whole["other"].to_numpy(), whole["n"].to_numpy(np.int64)
        return pd.DataFrame({"unit": [unit.tobytes()], "side": [(other % 2).astype(np.int8).tobytes()], "other": [(other // 2).astype(np.int32).tobytes()], "n": [n.tobytes()]})

    ordered = rows.repartition(parts, "unit").sortWithinPartitions("unit")
    out = stored(ordered.mapInPandas(pack, "unit binary, side binary, other binary, n binary"), "contexts")
    discard(found)
    return out


def unpacked(batches):
    """(unit, side, other, n) of each row that :func:`contexts_of` packed."""
    for pdf in batches:
        for unit, side, other, n in zip(pdf["unit"], pdf["side"], pdf["other"], pdf["n"]):
            yield np.frombuffer(unit, np.int32), np.frombuffer(side, np.int8).astype(np.int64), np.frombuffer(other, np.int32), np.frombuffer(n, np.int64)


def class_moves(contexts: DataFrame, cls: np.ndarray, classes: int) -> np.ndarray:
    """How often a token of each class follows one of each class."""

    def run(batches):
        sums = np.zeros(classes * classes)
        for unit, side, other, n in unpacked(batches):
            after = side == 1
            sums += np.bincount(cls[unit[after]] * classes + cls[other[after]], weights=n[after], minlength=len(sums))
        key = np.flatnonzero(sums)
        yield pd.DataFrame({"key": key, "n": sums[key].astype(np.int64)})

    return table_of(contexts.mapInPandas(run, "key long, n long"), classes)


def likelihood(moves: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training texts."""
    return float(_f(moves).sum() - _f(moves.sum(0)).sum() - _f(moves.sum(1)).sum())


def proposed(contexts: DataFrame, cls: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For every unit the class that gains most likelihood, the other units' classes as they are; units without a class (-1) tell nothing of their neighbours.

    To first order a unit with r[c] tokens of class c after it and l[c] before it adds to class k
    ``sum r[c] log(moves[k, c]) + sum l[c] log(moves[c, k])``, less its tokens times the logs of k's sums. A packed row's first and last unit may go on in
    others, so their gains are summed over rows first.
    """
    k = len(moves)
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = np.log(moves + 0.5)
    gain = np.stack([full - full.mean(), full.T - full.mean()])  # [side][class of the neighbour][own class]
    gain[0] -= np.log(moves.sum(0) + 0.5 * k)
    gain[1] -= np.log(moves.sum(1) + 0.5 * k)
    gain[:, :, 0] = -1e9
    gain = gain.astype(np.float32).reshape(2 * k, k)

    def best(batches):
        for unit, side, other, n in unpacked(batches):
            near = cls[other]
            keep = near >= 0
            if not keep.any():
                continue
            unit, near, n = unit[keep], (side * k + near)[keep], n[keep]
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            times = np.diff(np.append(heads, len(unit)))
            sums = np.empty((len(heads), k), dtype=np.float32)
            # Neighbours of frequent units are counted by class first.
            many = np.flatnonzero(times > 2 * k)
            for i in many:
                own = slice(heads[i], heads[i] + times[i])
                sums[i] = np.bincount(near[own], weights=n[own], minlength=2 * k).astype(np.float32) @ gain
            few = np.flatnonzero(times <= 2 * k)
            if len(few):
                rest = np.repeat(times <= 2 * k, times)
                starts = np.cumsum(times[few]) - times[few]
                sums[few] = np.add.reduceat(gain[near[rest]] * n[rest, None].astype(np.float32), starts)
            gains = [None] * len(heads)
            gains[0], gains[-1] = sums[0].tolist(), sums[-1].tolist()
            yield pd.DataFrame({"unit": unit[heads], "cls": sums.argmax(1), "gains": pd.Series(gains, dtype=object)})

    def settle(batches):
        own, held = None, None
        for pdf in batches:
            out = []
            for unit, c, gains in zip(pdf["unit"], pdf["cls"], pdf["gains"]):
                if unit != own:
                    if held is not None:
                        out.append((own, int(held.argmax())))
                    own, held = unit, None
                if gains is None:
                    out.append((unit, c))
                else:
                    held = gains if held is None else held + gains
            yield pd.DataFrame(out, columns=["unit", "cls"])
        if held is not None:
            yield pd.DataFrame({"unit": [own], "cls": [int(held.argmax())]})

    # One class for each unit reaches the driver.
    each = contexts.mapInPandas(best, "unit int, cls int, gains array<float>").repartition(parts, "unit").sortWithinPartitions("unit")
    found = each.mapInPandas(settle, "unit int, cls int").toArrow()
    out = np.where(cls >= 0, cls, 1)
    out[found["unit"].to_numpy()] = found["cls"].to_numpy()
    out[0] = 0
    return out


def exchanged(contexts: DataFrame, cls: np.ndarray, classes: int, moves: np.ndarray, seeds: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """A class for every unit and the class bigrams, by rounds of proposals from the seeds' classes on; in the first the seeds stay."""
    first = proposed(contexts, cls, moves)
    first[:seeds] = np.where(cls[:seeds] >= 0, cls[:seeds], first[:seeds])
    cls, moves = first, class_moves(contexts, first, classes)
    for _ in range(rounds):
        new = proposed(contexts, cls, moves)
        new_moves = class_moves(contexts, new, classes)
        if likelihood(new_moves) <= likelihood(moves):
            break
        moved = (new != cls).mean()
        cls, moves = new, new_moves
        if moved < 0.005:
            break
    return cls, moves


@dataclass
class BrownModel:
    """``units``, the class ``cls`` of each, its ``mass`` if it is a head word (else 0), and ``gain``: see :func:`fit`."""

    units: Units
    cls: np.ndarray
    mass: np.ndarray
    gain: np.ndarray
    tokens: int
    words: int
    end_known: bool

    def score(self, text: str | None):
        """(tokens, known head words, log10 masses of head words, class gain, {other word: times})."""
        words = tokens(text)
        seq = self.units.of(words)
        head = (seq > 1) & (seq < len(self.mass))
        rest = Counter(words[i] for i in np.flatnonzero(~head))
        cls = self.cls[np.concatenate([[0], seq, [0]])]
        mass = float(self.mass[seq[head]].sum() + self.mass[0])
        return len(words) + 1, int(head.sum()) + self.end_known, mass, float(self.gain[cls[:-1], cls[1:]].sum()), rest


def class_sizes(counts: DataFrame, shared, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class, over all counted words."""
    k = int(cls.max()) + 1

    def run(batches):
        sums = np.zeros((2, k), dtype=np.int64)
        for pdf in batches:
            own = cls[shared.value.of(pdf["word"].tolist())]
            np.add.at(sums[0], own, pdf["n"].to_numpy())
            np.add.at(sums[1], own, 1)
        yield pd.DataFrame({"cls": np.arange(k), "n": sums[0], "words": sums[1]})

    rows = counts.mapInPandas(run, "cls long, n long, words long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toPandas()
    out = np.zeros((2, k))
    out[:, rows["cls"].to_numpy(dtype=np.int64)] = rows[["n", "words"]].to_numpy(dtype=float).T
    return out[0], out[1]


def fit(train: DataFrame, counts: DataFrame, seeds: int = SEEDS, most_head: int = HEAD) -> BrownModel:
    """Clusters and estimates the model; ``gain[a, b]`` is what a token of class b after one of class a has over its unigram mass, in log10."""
    spark = train.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = dict(most_frequent(counts, most_head))
    end_known, end = END in head, head.pop(END, 0)
    ending = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    endings = counts.filter(F.col("word") != F.lit(END)).select(ending.alias("ending")).distinct().collect()
    units = Units(list(head), sorted(bytes(r["ending"]) for r in endings))
    shared = spark.sparkContext.broadcast(units)
    n_seeds = 2 + min(seeds, len(head))
    classes = int(np.clip(round(distinct ** (1 / 3)), 8, MOST_CLASSES))

    contexts = contexts_of(train, shared)

    def seed_pairs(batches):
        for unit, side, other, n in unpacked(batches):
            after = side == 1
            before_, after_ = (np.where(x[after] < n_seeds, x[after], 1).astype(np.int64) for x in (unit, other))
            key, back = np.unique(before_ * n_seeds + after_, return_inverse=True)
            yield pd.DataFrame({"key": key, "n": np.bincount(back, weights=n[after], minlength=len(key)).astype(np.int64)})

    pairs = table_of(contexts.mapInPandas(seed_pairs, "key long, n long"), n_seeds)
    own = exchange(pairs, classes)
    onehot = np.eye(classes)[own]
    cls = np.full(units.size, -1)
    cls[:n_seeds] = own
    cls[1] = -1
    cls, moves = exchanged(contexts, cls, classes, onehot.T @ pairs @ onehot, n_seeds)
    discard(contexts)
    n, words = class_sizes(counts, shared, cls)
    n, words = (np.concatenate([x, np.zeros(classes - len(x))]) for x in (n, words))
    share = (n + 0.5) / (n + 0.5).sum()
    moved = (moves + SMOOTH * share) / (moves.sum(1, keepdims=True) + SMOOTH)
    gain = np.log10(moved) - np.log10(n + 0.5 * (words + 1))
    mass = np.log10(np.array([end, 0, *head.values()], dtype=float) + 0.5)
    return BrownModel(units, cls, mass, gain, int(total), int(distinct), end_known)


def score_brown(docs: DataFrame, model: BrownModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, train_tokens, base_score (unigrams) and score, both in log10."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = float(np.log10(model.tokens + 0.5 * (model.words + 1)))

    def run(batches):
        from pyspark import TaskContext

        row, own = TaskContext.get().partitionId() << 40, shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                out = {c: [] for c in ("row", "id", "n_tokens", "known", "mass", "gain", "word", "times")}
                for key, text in zip(pdf["id"].iloc[at : at + 512], pdf["text"].iloc[at : at + 512]):
                    n, known, mass, gain, rest = own.score(text)
                    lines = [(key, n, known, mass, gain, None, 0), *((None, 0, 0, 0.0, 0.0, w, k) for w, k in rest.items())]
                    for line in lines:
                        for c, v in zip(out, (row, *line)):
                            out[c].append(v)
                    row += 1
                yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    flat = rows.mapInPandas(run, f"row long, id {kind}, n_tokens long, known long, mass double, gain double, word binary, times long")
    met = flat.join(counts.withColumnRenamed("n", "c"), "word", "left")
    mass = F.when(F.col("word").isNull(), F.col("mass")).otherwise(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    known = F.col("known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)
    sums = met.groupBy("row").agg(F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(mass).alias("mass"), F.sum("gain").alias("gain"))
    return sums.select(id_col, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("mass") - F.col("n_tokens") * base).alias("base_score"), (F.col("mass") + F.col("gain")).alias("score"))


def brown_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores for all rows of ``docs`` by a model of those that ``learn`` holds for."""
    train = docs.filter(learn).select(F.col(text_col).cast("string").alias("text"))
    counts = stored(word_counts(train), "words")
    return score_brown(docs, fit(train, counts), counts, id_col, text_col)


def op10_brown(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = brown_scores(docs, fold("doc_id", 5) != 1)
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
