"""Nearest neighbours by largest inner product over several shifted Hilbert orderings.

Vectors get one more coordinate, so that among vectors of one norm the nearest are those of largest inner product. Each
of CURVES curves projects them to DIMS random directions, shifts them, and orders the cells along a Hilbert curve. Each
order is cut at quantiles into CELLS ranges; a query is compared with all vectors of its own range and of REACH ranges
on either side. What the windows find is merged and reranked by the exact measure in double precision.

Every vector travels once a curve, as one signed byte a component; the error of that is measured, and whatever it could
hide is kept for the exact measure. A few curves go first: what they find bounds what the others need to report. Ranges
with over SLICE vectors are dealt into slices, each a task's group of bounded size; the queries of a group stream by it.

A window is a part of the corpus, not a number of rows, so recall doesn't fall as the corpus grows: CURVES windows of
(2 REACH + 1) / CELLS of all rows are 0.92 comparisons for each that an exhaustive search makes. That is sized for
vectors without any structure (64 independent coordinates); on clustered data far more CELLS and fewer CURVES do.
Equal vectors are searched as one; of their ids only as many as can be in a result are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import alike, mapped, mix, stored
from .learning import bounded

CURVES, DIMS, BITS, CELLS, REACH = 40, 12, 4, 130, 1
#: Curves whose finds bound those of the others, vectors in a slice, about, and those, about, that place the ranges' ends.
FIRST, SLICE, SAMPLE = 8, 16_384, 20_000
_TIE = 12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), each coordinate of `bits` bits."""
    x = cells.T.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, norm: float, ids: np.ndarray, curves: range, queries: bool = False, seed: int = 17) -> np.ndarray:
    """(n, curves) keys. Vectors are completed to length `norm`, queries scaled to it. Places in a cell go by a hash of the id."""
    length = np.linalg.norm(vectors, axis=1)
    if queries:
        vectors, extra = vectors * (norm / length)[:, None], np.zeros(len(vectors))
    else:
        extra = np.sqrt(np.maximum(norm * norm - length * length, 0))
    full = np.column_stack([vectors, extra]) / norm
    out, dims, spread = np.zeros((len(full), len(curves)), np.int64), min(DIMS, full.shape[1]), np.sqrt(full.shape[1])
    for i, c in enumerate(curves):
        rng = np.random.default_rng([seed, c])
        basis = np.linalg.qr(rng.normal(size=(full.shape[1], dims)))[0]
        cells = np.clip(((full @ basis) * spread + rng.uniform(-0.5, 0.5, dims)) / 6 + 0.5, 0, 1 - 1e-9) * (1 << BITS)
        tie = mix(ids.astype(np.uint64) * np.uint64(CURVES) + np.uint64(c)).astype(np.int64) & ((1 << _TIE) - 1)
        out[:, i] = hilbert_keys(cells.astype(np.int64), BITS) << _TIE | tie
    return out


def _matrix(raw: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype=kind).reshape(len(raw), -1).astype(np.float64)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one signed byte a component, what to multiply them by) of each vector."""
    scale = (np.abs(x).max(axis=1, initial=0) / 127).astype(np.float32)
    return np.rint(x / np.maximum(scale, np.float32(1e-38))[:, None]).clip(-127, 127).astype(np.int8), scale


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """((vec_id, v) of the vectors that take part, numpy type of v's bytes); shorter ones count as followed by zeros."""
    kind = "<f4" if "float" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    e = F.col(vector_col)
    whole = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("vec_id"), e.cast("array<float>" if kind == "<f4" else "array<double>").alias("e"))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            x = np.zeros((batch.num_rows, width), kind)
            x[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            x = x + np.zeros(1, kind)  # -0.0 is 0.0
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "v"])

    return mapped(rows, run, "vec_id long, v binary"), kind


_DEALT = "grp int, part int, asks int, id long, size float, v binary, least float"


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every` the k other rows of largest inner product found.

    Ties go to the smaller vec_id; fewer rows if there are fewer candidates. Windows hold 2 k rows at least, on average,
    so tables of fewer rows than that are searched whole. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do null ids; where lengths differ, the shorter vectors count as followed by zeros. A
    repeated id takes part as often as it comes with different vectors (once for equal ones) and is never its own
    neighbour. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows, kind = valid_vectors(vectors, id_col, vector_col)
    rows = stored(rows.distinct(), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    members = stored(members.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))), "vector-members")
    reps = members.filter("_n = 1").select("rep", "v")

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), kind)
                code, scale = codes(x)
                off = np.linalg.norm(x - code * scale[:, None].astype(np.float64), axis=1)
                yield pa.record_batch([pa.array([float(np.linalg.norm(x, axis=1).max())]), pa.array([float(off.max())]), pa.array([len(x)])], names=["most", "off", "n"])

    norm, off, n = mapped(reps.select("v"), measures, "most double, off double, n long").agg(F.max("most"), F.max("off"), F.coalesce(F.sum("n"), F.lit(0))).first()
    norm, off = norm or 1.0, (off or 0.0) + 1e-5 * (norm or 1.0)  # and what single precision adds
    cells = int(max(1, min(CELLS, n * (2 * REACH + 1) // (2 * k))))
    slices = int(max(1, -(-n // (cells * SLICE))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curve_keys(_matrix(batch.column(1), kind), norm, batch.column(0).to_numpy(), range(CURVES))
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * CURVES), pa.array(keys.ravel()))], names=["keys"])

    ends = np.zeros((0, CURVES), np.int64)
    if cells > 1:
        sample = mapped(bounded(reps, SAMPLE, "rep"), placed, "keys array<long>").toArrow()["keys"].combine_chunks().flatten().to_numpy().reshape(-1, CURVES)
        ends = np.sort(sample, axis=0)[np.arange(1, cells) * len(sample) // cells]
    sent = spark.sparkContext.broadcast(ends)

    def dealt(df: DataFrame, curves: range, asks: bool) -> DataFrame:
        """Each row of df (id, v[, least]) once for each curve and range that it is in or asks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), kind)
                keys, m = curve_keys(x, norm, ids, curves, asks), len(ids)
                if asks:
                    sizes, v, least = np.linalg.norm(x, axis=1).astype(np.float32), batch.column(1), batch.column(2)
                    where = [(step, part) for step in range(-REACH, REACH + 1) for part in range(slices)]
                else:
                    code, sizes = codes(x)
                    v, least = pa.array([r.tobytes() for r in code], pa.binary()), pa.nulls(m, pa.float32())
                    where = [(0, (mix(ids.astype(np.uint64)) % np.uint64(slices)).astype(np.int32))]
                for i, c in enumerate(curves):
                    at = np.searchsorted(sent.value[:, c], keys[:, i], side="right")
                    for step, part in where:
                        use = np.flatnonzero((at + step >= 0) & (at + step < cells))
                        own = pa.record_batch([pa.array((c * cells + at + step).astype(np.int32)), pa.array(np.broadcast_to(np.int32(part), m)), pa.array(np.full(m, asks, np.int32)), batch.column(0), pa.array(sizes), v, least], names=["grp", "part", "asks", "id", "size", "v", "least"])
                        yield own if len(use) == m else own.take(pa.array(use))

        return mapped(df, run, _DEALT)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ids, x = None, [], None, None
        for batch in batches:
            for lo, hi in alike(*batch.columns[:3]):
                grp, part, asks, own, size, v, least = batch.slice(lo, hi - lo).columns
                if (grp[0].as_py(), part[0].as_py()) != here:
                    here, held, x = (grp[0].as_py(), part[0].as_py()), [], None
                if not asks[0].as_py():  # the vectors come first
                    held.append((own.to_numpy(), np.frombuffer(b"".join(v.to_pylist()), np.int8).reshape(len(v), -1) * size.to_numpy()[:, None]))
                    continue
                if not held:
                    continue
                if x is None:
                    ids, x = (np.concatenate(p) for p in zip(*held))
                    held = held[:1]
                for at in range(0, len(own), 256):
                    q, near = own.to_numpy()[at : at + 256], _matrix(v.slice(at, 256), kind).astype(np.float32)
                    scores = near @ x.T
                    floor = np.nan_to_num(least.slice(at, 256).to_numpy(zero_copy_only=False).astype(np.float32), nan=-np.inf)
                    if len(ids) > k:
                        floor = np.maximum(floor, np.partition(scores, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
                    ask, col = np.nonzero(scores >= (floor - 2 * off * size.to_numpy()[at : at + 256])[:, None])
                    yield pa.record_batch([pa.array(q[ask]), pa.array(ids[col]), pa.array(scores[ask, col])], names=["ask", "rep", "score"])

    def found(asked: DataFrame, curves: range) -> DataFrame:
        both = dealt(reps.withColumnRenamed("rep", "id"), curves, False).union(dealt(asked, curves, True))
        best = mapped(both.repartition("grp", "part").sortWithinPartitions("grp", "part", "asks"), search, "ask long, rep long, score float")
        return stored(best.groupBy("ask", "rep").agg(F.max("score").alias("score")), "vector-found")

    def ranked(df: DataFrame, *order) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy("ask").orderBy(*order)))

    asking = stored(rows.filter(F.col("vec_id") % every == 0).groupBy("v").agg(F.min("vec_id").alias("ask")).select("ask", "v"), "vector-queries")
    ahead = found(asking.select("ask", "v", F.lit(None).cast("float").alias("least")), range(FIRST))
    least = ranked(ahead, F.desc("score")).filter(F.col("_n") == k + 1).select("ask", F.col("score").alias("least"))
    rest = found(asking.join(least, "ask", "left").select("ask", "v", "least"), range(FIRST, CURVES))
    once = ahead.union(rest).groupBy("ask", "rep").agg(F.max("score").alias("score"))
    least = ranked(once, F.desc("score")).filter(F.col("_n") == k + 1).select("ask", F.col("score").alias("least"))
    close = once.join(asking.withColumnRenamed("v", "q"), "ask").join(least, "ask", "left").join(reps, "rep")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, x = _matrix(batch.column(3), kind), _matrix(batch.column(4), kind)
                floor = np.nan_to_num(batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                use = pa.array(np.flatnonzero(batch.column(2).to_numpy() >= floor - 2 * off * np.linalg.norm(q, axis=1)))
                yield pa.record_batch([batch.column(0).take(use), batch.column(1).take(use), pa.array(np.einsum("ij,ij->i", q, x)).take(use)], names=["ask", "rep", "score"])

    near = mapped(close.select("ask", "rep", "score", "q", "v", "least"), exact, "ask long, rep long, score double")
    near = ranked(near, F.desc("score"), "rep").filter(F.col("_n") <= k + 1).drop("_n")
    # every query id of the vector, every kept id of the vectors near it
    who = rows.filter(F.col("vec_id") % every == 0).join(asking, "v").select(F.col("vec_id").alias("query_id"), "ask")
    pairs = ranked(near.join(members.select("rep", "vec_id"), "rep"), F.desc("score"), "vec_id").filter(F.col("_n") <= k + 1)
    pairs = who.join(pairs.select("ask", "vec_id", "score"), "ask").filter("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
