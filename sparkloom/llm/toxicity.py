"""Toxicity by logistic regression with FTRL-proximal steps over hashed word n-grams and skip-grams.

Features of a text are the hashed words and their beginnings, pairs of neighbours and pairs with one word between,
each counted once. Every
shard of the sample learns on its own with per-coordinate rates and L1 sparsity; the shards' weights are averaged in
Spark, and what is left is small enough to broadcast: at most SIZE weights whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER_NP, NOT_ALNUM, chunked, mapped, mix, prefix_sums, slice_hashes, stored, text_bytes, word_bounds
from .learning import bounded, held_out, one_text, training_labels

#: Bytes of the word beginnings that count as features of their own, so that inflected forms share what is learnt.
BEGINNINGS = (4, 5, 6, 7)
#: Hashed feature space, labelled rows, about, that the model is fitted on at most, and shards that learn side by side.
SIZE, SAMPLE, SHARDS = 1 << 20, 24_000, 4


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every word, word beginning, neighbour pair and skip pair, repeats included."""
    lower = LOWER_NP[data]
    start, end, row = word_bounds(lower, offsets, NOT_ALNUM)
    sums = prefix_sums(lower)
    keys = slice_hashes(sums, start, end)
    parts, rows = [keys], [row]
    for size in BEGINNINGS:
        longer = end - start > size
        parts.append(slice_hashes(sums, start[longer], start[longer] + size) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        rows.append(row[longer])
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(keys) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix(keys[:-gap] * np.uint64(salt) + keys[gap:])
            parts.append(pair[same])
            rows.append(row[gap:][same])
    return (np.concatenate(parts) % np.uint64(SIZE)).astype(np.int64), np.concatenate(rows)


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) once each, ordered by row."""
    both = np.unique(row * SIZE + feature)
    return both % SIZE, both // SIZE


class Ftrl:
    """FTRL-proximal state: z and n of each coordinate; weights are derived, most are exactly zero."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.where(at == SIZE, z, np.sign(z) * np.maximum(np.abs(z) - self.l1, 0))
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, SIZE)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit_rows(features: np.ndarray, rows: np.ndarray, labels: np.ndarray, epochs: int = 5, seed: int = 3) -> np.ndarray:
    """The SIZE + 1 weights (the last is the offset) after `epochs` passes in seeded random order."""
    model, rng = Ftrl(), np.random.default_rng(seed)
    bounds = np.searchsorted(rows, np.arange(len(labels) + 1))
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            model.learn(features[bounds[i] : bounds[i + 1]], float(labels[i]))
    return model.weights(np.arange(SIZE + 1))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, remainder: int = 2, sample: int = SAMPLE, shards: int = SHARDS) -> np.ndarray:
    """Weights fitted on about `sample` labelled ids at most, one text each; docs has doc_id and text. Labels of held-out ids are never read."""
    known = bounded(training_labels(labels, label_col, modulus, remainder), sample)
    rows = one_text(docs, known).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        feature, row = [], []
        for lo, _, data, offsets in chunked(pa.array(pdf["text"], pa.string())):
            f, r = distinct(*hashed(data, offsets))
            feature.append(f)
            row.append(r + lo)
        w = fit_rows(np.concatenate(feature), np.concatenate(row), pdf["label"].to_numpy())
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": at, "weight": w[at]})

    learnt = rows.groupBy("shard").applyInPandas(learn, "feature int, weight double")

    mean = learnt.groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).collect()
    weights = np.zeros(SIZE + 1, np.float32)
    if mean:
        weights[[r.feature for r in mean]] = [r.weight for r in mean]
    return weights


def score_texts(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    feature, row = hashed(data, offsets)
    hit = weights[feature] != 0
    feature, row = distinct(feature[hit], row[hit])
    total = np.bincount(row, weights[feature], len(offsets) - 1) + float(weights[SIZE])
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, remainder: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts are empty and get the model's offset alone; null ids are scored, never learnt from; repeated rows stay, and
    an id that is labelled teaches once (see one_text). Very long texts are scored whole, each feature counting once.
    Without labels every score is 0.5. Extra columns are ignored and never inputs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weights = train(rows, labels, label_col, modulus, remainder, sample)
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SIZE + 1, np.float32)
        own[sent.value[0]] = sent.value[1]
        for batch in batches:
            made = [score_texts(own, data, offsets) for _, _, data, offsets in chunked(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([*made, np.zeros(0)]))], names=["doc_id", "score"])

    scored = mapped(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
