"""Toxicity by a convolutional text classifier trained in numpy.

Words hash into an embedding table; filters of several widths slide over the embedded words, keep their
largest response in the text, and a dense layer adds those up. The table starts from smoothed log-odds of
each bucket in the labelled texts, then table, filters and dense layer are trained together by Adam. A
logistic curve fitted on texts left out of the training turns the output into a probability.
Flagging thresholds are calibrated for each language on the same texts; language never enters a score.

Defined results: null and empty texts score as a text without any response; long texts are read whole,
position by position; repeated rows score alike; without labels, or with one label only, every score is
the share of toxic labels (0 without any). A null or unseen language takes the threshold of all.
Only the named columns are read, so other columns have no effect.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import fit_logistic, fold, labelled_sample, read, sigmoid

BUCKETS = 1 << 20
DIM = 4
WIDTHS = (1, 2, 3)
FILTERS = 6
#: The most labelled rows a model is fitted on.
MAX_LABELLED = 6000
EPOCHS = 6
MIN_DOCS = 3
THRESHOLD = 0.7
_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def word_buckets(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()
    return np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) & (BUCKETS - 1)


@dataclass
class ToxicityModel:
    """Rows of ``table`` stand for the buckets in ``known`` (sorted); all other buckets embed as zero."""

    known: np.ndarray
    table: np.ndarray
    filters: list = field(default_factory=list)
    dense: np.ndarray | None = None
    curve: tuple = (0.0, 0.0)
    thresholds: dict = field(default_factory=dict)

    def lookup(self) -> np.ndarray:
        rows = np.zeros(BUCKETS, dtype=np.int32)
        rows[self.known] = np.arange(1, len(self.known) + 1)
        return rows

    def scores(self, texts: list[str | None], lookup: np.ndarray | None = None) -> np.ndarray:
        if self.dense is None:
            return np.full(len(texts), self.curve[1])
        rows = self.lookup() if lookup is None else lookup
        ids = [rows[word_buckets(t)] for t in texts]
        pooled = np.concatenate([pool(self, part)[0] for part in packs(ids)]) if ids else np.zeros((0, 1))
        raw = pooled @ self.dense[:-1] + self.dense[-1]
        return sigmoid(self.curve[0] * raw + self.curve[1])


def packs(ids: list[np.ndarray], most: int = 200_000):
    """Groups of texts of about ``most`` words, so that memory doesn't follow the number of texts."""
    part, size = [], 0
    for x in ids:
        if part and size + len(x) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def pool(model: ToxicityModel, ids: list[np.ndarray], want_at: bool = False):
    """The largest response of each filter in each text (at least 0) and where it was, else -1.

    Texts stand one after another, parted by as many zero words as the widest filter reaches over.
    """
    gap = max(WIDTHS) - 1
    starts, at = [], 0
    for x in ids:
        starts.append(at)
        at += len(x) + gap
    flat = np.zeros(at + gap, dtype=np.int64)
    for s, x in zip(starts, ids):
        flat[s : s + len(x)] = x
    emb = model.table[flat]
    out = np.zeros((len(ids), len(WIDTHS) * FILTERS))
    where = np.full(out.shape, -1, dtype=np.int64)
    for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
        resp = np.broadcast_to(f[-1], (at, FILTERS)).copy()
        for j in range(w):
            resp += emb[j : j + at] @ f[j * DIM : (j + 1) * DIM]
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        if want_at:
            for i, (s, x) in enumerate(zip(starts, ids)):
                if len(x):
                    best = resp[s : s + len(x)].argmax(0)
                    out[i, cols] = resp[s + best, np.arange(FILTERS)]
                    where[i, cols] = s + best
        elif len(ids):
            live = np.array([len(x) > 0 for x in ids])
            # From start to end of each text: windows that start in the gap after it may reach into the next.
            edges = np.array([(s, s + len(x)) for s, x in zip(starts, ids) if len(x)], dtype=np.int64).ravel()
            out[live, cols] = np.maximum.reduceat(resp, edges)[::2] if live.any() else out[:0, cols]
    where[out <= 0] = -1
    return np.maximum(out, 0.0), where, flat


def new_model(ids: list[np.ndarray], y: np.ndarray, seed: int) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    df = np.zeros((2, BUCKETS), dtype=np.float32)
    for x, label in zip(ids, y):
        df[label, np.unique(x)] += 1
    known = np.flatnonzero(df.sum(0) >= MIN_DOCS)
    n = np.array([(y == k).sum() for k in (0, 1)], dtype=float)
    rate = (df[:, known] + 0.5 * n[:, None] / n.sum()) / (n[:, None] + 1)
    odds = np.log(rate[1] / rate[0]) * np.minimum(1, df[:, known].sum(0) / 10)
    table = np.zeros((len(known) + 1, DIM), dtype=np.float32)
    table[1:] = rng.normal(0, 0.05, (len(known), DIM))
    table[1:, 0] += np.clip(odds, -3, 3)
    filters = []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w * DIM + 1, FILTERS))
        f[0:-1:DIM] += 0.5
        f[-1] = -0.8
        filters.append(f.astype(np.float32))
    return ToxicityModel(known, table, filters, np.concatenate([np.full(len(WIDTHS) * FILTERS, 0.3), [-1.0]]))


def train(model: ToxicityModel, ids: list[np.ndarray], y: np.ndarray, epochs: int, seed: int) -> None:
    """Adam on the weighted log loss; labels weigh so that both have the same sum."""
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    params = {"dense": model.dense, **{f"f{k}": f for k, f in enumerate(model.filters)}, "table": model.table}
    m, v, t = {k: np.zeros(p.shape) for k, p in params.items()}, {k: np.zeros(p.shape) for k, p in params.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            pooled, where, flat = pool(model, [ids[i] for i in pick], want_at=True)
            err = (sigmoid(pooled @ model.dense[:-1] + model.dense[-1]) - y[pick]) * weight[pick] / len(pick)
            grad = {"dense": np.concatenate([pooled.T @ err, [err.sum()]]) + 1e-3 * model.dense}
            back = err[:, None] * model.dense[:-1][None]
            touched, pulls = [], []
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                g = np.zeros(f.shape)
                for c in range(FILTERS):
                    pos, up = where[:, k * FILTERS + c], back[:, k * FILTERS + c]
                    up, pos = up[pos >= 0], pos[pos >= 0]
                    g[-1, c] = up.sum()
                    for j in range(w):
                        rows = flat[pos + j]
                        g[j * DIM : (j + 1) * DIM, c] = model.table[rows].T @ up
                        touched.append(rows)
                        pulls.append(up[:, None] * f[j * DIM : (j + 1) * DIM, c][None])
                grad[f"f{k}"] = g + 1e-4 * f
            t += 1
            rate = 0.02 / (1 + epoch) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                params[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(params[name].dtype)
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            pull = np.zeros((len(rows), DIM))
            np.add.at(pull, inverse, np.concatenate(pulls))
            live = rows > 0
            rows, pull = rows[live], pull[live]
            m["table"][rows] = 0.9 * m["table"][rows] + 0.1 * pull
            v["table"][rows] = 0.999 * v["table"][rows] + 0.001 * pull * pull
            model.table[rows] -= (rate * m["table"][rows] / (np.sqrt(v["table"][rows]) + 1e-8)).astype(np.float32)


def fit(texts: list[str], labels: list[int], langs: list[str | None], epochs: int = EPOCHS, seed: int = 7) -> ToxicityModel:
    y = np.array(labels, dtype=int)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(0, int), np.zeros((1, DIM), np.float32), curve=(0.0, float(y.mean()) if len(y) else 0.0))
    raw = [word_buckets(t) for t in texts]
    left_out = np.arange(len(y)) % 4 == 3
    if len(set(y[left_out].tolist())) < 2 or len(set(y[~left_out].tolist())) < 2:
        left_out = np.zeros(len(y), bool)
    learn = np.flatnonzero(~left_out)
    check = np.flatnonzero(left_out) if left_out.any() else learn
    model = new_model([raw[i] for i in learn], y[learn], seed)
    rows = model.lookup()
    ids = [rows[x] for x in raw]
    train(model, [ids[i] for i in learn], y[learn], epochs, seed)
    pooled = np.concatenate([pool(model, part)[0] for part in packs([ids[i] for i in check])])
    out = pooled @ model.dense[:-1] + model.dense[-1]
    model.curve = tuple(map(float, fit_logistic(out[:, None], y[check], l2=1e-4)))
    if model.curve[0] <= 0:
        model.curve = (1e-3, float(np.log(y.mean() / (1 - y.mean()))))
    score = sigmoid(model.curve[0] * out + model.curve[1])
    by_lang = np.array([langs[i] or "" for i in check])
    model.thresholds = {"": best_cut(score, y[check])}
    for lang in sorted(set(by_lang.tolist()) - {""}):
        own = by_lang == lang
        if y[check][own].sum() >= 10:
            model.thresholds[lang] = best_cut(score[own], y[check][own])
    return model


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; of equal ones the highest."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)[0]
    low = score[order][best + 1] if best + 1 < len(y) else 0.0
    return float((score[order][best] + low) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_LABELLED) -> ToxicityModel:
    rows = labelled_sample(docs, labels, "toxic", keep, max_rows, ("lang",))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], [r["lang"] for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, score, predicted, and flagged: whether the score reaches its language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, lookup = shared.value, shared.value.lookup()
        for pdf in batches:
            score = model.scores(pdf["text"].tolist(), lookup)
            cut = pdf["lang"].map(model.thresholds).astype(float).fillna(model.thresholds.get("", threshold))
            yield pd.DataFrame({"id": pdf["id"], "score": score, "predicted": (score >= threshold).astype("int32"), "flagged": score >= cut.to_numpy()})

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return rows.mapInPandas(run, f"id {kind}, score double, predicted int, flagged boolean").withColumnRenamed("id", id_col)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "flagged")
