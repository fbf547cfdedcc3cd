"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, fits a text better.

Both dictionaries are built from labelled texts. A text is cut into fixed blocks, every block is
compressed with each dictionary and with none, and the summed sizes give normalised differences
``(a - b) / (a + b)``: bad against good, none against either, and the plain length against none, which
shows text that only repeats itself. A logistic curve fitted on labelled texts makes a probability of
them. Lines that labelled texts of both kinds hold say nothing about quality and stay out of the
dictionaries.

Defined results: null and empty texts get the score of a text without evidence (difference 0); long texts
are read whole, block by block; repeated rows score alike; without labels, or with one label only, every
score is the share of good labels (0.5 without any). Only ``id_col`` and ``text_col`` are read, so
other columns, whatever their names, have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import fit_logistic, fold, labelled_sample, read, sigmoid

#: Bytes compressed at a time; blocks keep the dictionary's share of a long text's size from vanishing.
BLOCK = 1024
DICT_BYTES = 48 * 1024
#: The most labelled rows a model is fitted on.
MAX_LABELLED = 8000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), self.prior)
        return sigmoid(np.column_stack([features(texts, self.good, self.bad), np.ones(len(texts))]) @ np.array(self.weights))


@lru_cache(maxsize=4)
def compressors(good: bytes, bad: bytes):
    return [zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False) for d in map(as_dict, (good, bad))] + [
        zstandard.ZstdCompressor(level=1, write_content_size=False)
    ]


def as_dict(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=1)
    return d


def features(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Per text the normalised size differences; zeros for an empty text."""
    by_good, by_bad, plain = compressors(good, bad)
    out = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            continue
        g = b = p = 0
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            g += len(by_good.compress(part))
            b += len(by_bad.compress(part))
            p += len(plain.compress(part))
        own = 4 * (len(data) - p) / (len(data) + p)
        out[i] = 10 * (b - g) / (b + g), 10 * (p - g) / (p + g), 10 * (p - b) / (p + b), own, own * own
    return out


def build_dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on blocks of the texts; too few blocks to train on serve as its raw content."""
    blocks = [data[at : at + BLOCK] for data in (t.encode("utf-8", "surrogatepass") for t in texts) for at in range(0, len(data), BLOCK)]
    if len(blocks) >= 64:
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(blocks)[:DICT_BYTES]


def own_lines(texts: list[str], labels: np.ndarray) -> list[str]:
    """The texts without the lines that both kinds hold, and without repeats of a whole text."""
    kinds: dict[str, int] = {}
    for text, label in zip(texts, labels):
        for line in set(text.split("\n")):
            kinds[line] = kinds.get(line, 0) | 1 << int(label)
    seen, out = set(), []
    for text in texts:
        out.append("" if text in seen else "\n".join(x for x in text.split("\n") if kinds[x] != 3))
        seen.add(text)
    return out


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Half of the texts build the dictionaries, the other half calibrate; then the halves change roles."""
    y = np.array(labels, dtype=int)
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return QualityModel(b"", b"", (), prior)
    half = np.arange(len(y)) % 2
    plain = own_lines(texts, y)
    rows, truth = [], []
    for part in (0, 1):
        own = [(t, v) for t, v, h in zip(plain, y, half) if h == part]
        rest = [(t, v) for t, v, h in zip(texts, y, half) if h != part]
        good, bad = (build_dictionary([t for t, v in own if v == k]) for k in (1, 0))
        if good and bad and rest:
            rows.append(features([t for t, _ in rest], good, bad))
            truth += [v for _, v in rest]
    good, bad = (build_dictionary([t for t, v in zip(plain, y) if v == k]) for k in (1, 0))
    if not rows or not good or not bad:
        return QualityModel(b"", b"", (), prior)
    return QualityModel(good, bad, tuple(map(float, fit_logistic(np.concatenate(rows), truth))), prior)


def fit_quality(docs: DataFrame, labels: DataFrame, keep, max_rows: int = MAX_LABELLED) -> QualityModel:
    rows = labelled_sample(docs, labels, "quality", keep, max_rows)
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, score and predicted (1: keep) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            score = shared.value.scores(pdf["text"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for pdf in batches:
            yield pdf[shared.value.scores(pdf.iloc[:, place].tolist()) >= threshold]

    return docs.mapInPandas(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
