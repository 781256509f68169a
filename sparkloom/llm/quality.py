"""Text quality by positive-unlabelled learning.

Trusted positives and a sample of unlabelled web text fit a logistic model on shape statistics of texts by the
non-negative unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The class prior is
estimated from the same two samples (no trusted negative is used): a first model is fitted on half of both, and over the
thresholds on the other half's scores the share of unlabelled rows above is divided by that of positives above; where
the scores part the classes, the least such ratio is the share of positives among the unlabelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER_NP, NOT_ALNUM, chunked, mapped, mix, prefix_sums, slice_hashes, word_bounds
from .learning import bounded, held_out, one_text, training_labels

#: Rows, about, of either sample that the model is fitted on at most.
SAMPLE = 10_000
BINS = 12

_MARKS = "!?.,;:*%&#$|\"'()-/@=_<>[]{}"
_GROUP = np.zeros(256, np.int64)
for _byte in range(256):
    _c = chr(_byte)
    _GROUP[_byte] = 1 if _byte >= 128 else 2 if _c.isupper() else 3 if _c.islower() else 4 if _c.isdigit() else 5 if _c == "\n" else 6 if _c.isspace() else 7 + _MARKS.index(_c) if _c in _MARKS else 0
_GROUPS = 7 + len(_MARKS)
FEATURES = _GROUPS + 9


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text: shares of byte kinds, word shapes and repetition; empty texts are zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * _GROUPS + _GROUP[data], minlength=n * _GROUPS).reshape(n, _GROUPS)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :_GROUPS] = kinds / np.maximum(size, 1)[:, None]
    lower = LOWER_NP[data]
    start, end, owner = word_bounds(lower, offsets, NOT_ALNUM)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    length = end - start
    out[:, _GROUPS] = np.log1p(words)
    out[:, _GROUPS + 1] = np.bincount(owner, length, n) / some
    out[:, _GROUPS + 2] = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / some - out[:, _GROUPS + 1] ** 2, 0))
    if len(start):
        keys = slice_hashes(prefix_sums(lower), start, end)
        both = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(both, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = both[order][1:] != both[order][:-1]
        distinct = owner[order][fresh]
        run = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        out[:, _GROUPS + 3] = np.bincount(distinct, minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, distinct, run)
        out[:, _GROUPS + 4] = top / some
        same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
        out[:, _GROUPS + 5] = np.bincount(owner[1:][same], minlength=n) / some
        gap = start[1:] - end[:-1]
        inside = owner[1:] == owner[:-1]
        out[:, _GROUPS + 6] = np.bincount(owner[1:][inside], gap[inside], n) / some
        out[:, _GROUPS + 7] = np.bincount(owner, length == 1, n) / some
    lines = kinds[:, 5] + 1
    out[:, _GROUPS + 8] = np.log1p(size / lines)
    return out


class Model:
    """Quantile bins of each statistic, one weight for each bin and an offset."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, offset: float):
        self.edges, self.weights, self.offset = edges, weights, offset

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1) + np.arange(x.shape[1]) * (BINS + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.weights[self.bins(x)].sum(axis=1) + self.offset, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimises the non-negative risk by Adam; where the negative part is below zero, its gradient is taken back."""
    every = np.concatenate([positive, unlabelled])
    if not len(every):
        return Model(np.zeros((FEATURES, BINS)), np.zeros(FEATURES * (BINS + 1)), 0.0)
    prior = float(np.clip(prior, 0.01, 0.99))
    edges = np.quantile(every, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Model(edges, np.zeros(FEATURES * (BINS + 1)), float(np.log(prior / (1 - prior))))
    bins_p, bins_u = model.bins(positive) if len(positive) else None, model.bins(unlabelled) if len(unlabelled) else None
    if bins_p is None or bins_u is None:
        return model
    width = len(model.weights)
    m, v = np.zeros(width + 1), np.zeros(width + 1)

    def slope(bins: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(bins.ravel(), np.repeat(g, bins.shape[1]), width), g.sum())

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, steps + 1):
        zp, zu = model.weights[bins_p].sum(1) + model.offset, model.weights[bins_u].sum(1) + model.offset
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = slope(bins_u, sigmoid(zu) / len(zu)) - prior * slope(bins_p, sigmoid(zp) / len(zp))
        g = prior * slope(bins_p, (sigmoid(zp) - 1) / len(zp)) + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weights -= move[:-1]
        model.offset -= move[-1]
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of both: the ratio of the shares above the best threshold.

    The threshold is where the ratio's upper confidence bound is least.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    above_p = 1 - np.arange(len(positive)) / len(positive)
    above_u = 1 - np.searchsorted(unlabelled, positive) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_samples(positive: np.ndarray, positive_ids: np.ndarray, unlabelled: np.ndarray, unlabelled_ids: np.ndarray) -> Model:
    """A model of both samples with the class prior estimated from them; halves go by id, as a row may be in both samples."""
    p, u = (mix(ids.astype(np.uint64)) & np.uint64(1) == 0 for ids in (positive_ids, unlabelled_ids))
    first = fit(positive[p], unlabelled[u], 0.5, steps=200)
    return fit(positive, unlabelled, estimated_prior(first.scores(positive[~p]), first.scores(unlabelled[~u])))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) of every row of docs (doc_id, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1)):
                x = text_features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "x"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, x array<float>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, remainder: int = 0, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` trusted positives at most and as many unlabelled rows of docs (doc_id, text), one text an id.

    Labels of held-out ids and labels other than 1 are never read.
    """
    known = training_labels(labels, label_col, modulus, remainder).filter("label = 1")
    positive = one_text(docs, bounded(known, sample).select("doc_id"))
    unlabelled = bounded(docs.filter("doc_id is not null"), sample).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def matrix(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = features(df).toArrow()
        x, ids = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES), table["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        return x[order], ids[order]

    return fit_samples(*matrix(positive), *matrix(unlabelled))


def _scorer(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, remainder: int, sample: int):
    """A function for tasks: Arrow texts to scores, after a model fitted on docs and labels."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, labels, label_col, modulus, remainder, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights, model.offset))

    def scores(texts: pa.Array) -> np.ndarray:
        own = Model(*sent.value)
        return np.concatenate([np.zeros(0), *(own.scores(text_features(data, offsets)) for _, _, data, offsets in chunked(texts))])

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, remainder: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts are empty and scored like any other; null ids are scored, never learnt from; repeated rows stay, and an id
    teaches once (see one_text). Very long texts are scored whole. Without labels every score is 0.5. Extra columns are
    ignored and never inputs.
    """
    scores = _scorer(docs, labels, id_col, text_col, label_col, modulus, remainder, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = mapped(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, remainder: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is at least the threshold, all columns as they are. See quality_scores()."""
    scores, place = _scorer(docs, labels, id_col, text_col, label_col, modulus, remainder, sample), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(place)) >= threshold))

    return mapped(docs, run, docs.schema)
