"""Centroid clustering (Lloyd's rounds) in exact integers with a Walsh-Hadamard progressive search.

Vectors and centroids go through the integer Walsh-Hadamard transform, which scales every squared distance by its length.
Differences of coefficients are added from coarse to fine (few sign changes first); what is summed so far is a lower
bound, so a centroid whose sum exceeds the full distance of the most promising one is strictly worse and drops out. The
others are summed to the last coefficient, hence ties and distances are exact. A round is one pass over the vectors: each
task sends a sum and a count for each centroid, so a cluster that holds most of the rows costs one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped, stored

#: Components beyond this are computed with Python's integers: squared sums would not fit 64 bits.
PLAIN = 1 << 20
#: Components from here on are refused.
LIMIT = 1 << 62


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two long), coefficients by number of sign changes."""
    n, width = rows.shape
    out = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.concatenate([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out[:, sequency(width)]


def sequency(width: int) -> np.ndarray:
    """The order of the transform's coefficients by number of sign changes of their row."""
    signs = np.array([[bin(i & j).count("1") & 1 for j in range(width)] for i in range(width)])
    return np.argsort(np.abs(np.diff(signs, axis=1)).sum(axis=1), kind="stable")


def steps(width: int) -> list[tuple[int, int]]:
    """Ranges of coefficients, each reaching four times as far as the one before."""
    bounds = [0, *[b for b in (4, 16, 64, 256, 1024) if b < width], width]
    return list(zip(bounds, bounds[1:]))


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number.

    Both are int64, or hold Python integers where distances could pass 64 bits.
    """
    if max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0)) > PLAIN:
        values, centroids = values.astype(object), centroids.astype(object)
    width = values.shape[1]
    v, c = hadamard(values), hadamard(centroids)
    (_, first), *finer = steps(width)
    coarse = np.stack([((v[:, :first] - own) ** 2).sum(axis=1) for own in c[:, :first]], axis=1)
    bound = ((v - c[coarse.argmin(axis=1)]) ** 2).sum(axis=1)
    row, number = np.nonzero(coarse <= bound[:, None])
    total = coarse[row, number]
    for lo, hi in finer:
        total = total + ((v[row, lo:hi] - c[number, lo:hi]) ** 2).sum(axis=1)
        left = total <= bound[row]
        row, number, total = row[left], number[left], total[left]
    least = np.minimum.reduceat(total, np.searchsorted(row, np.arange(len(values))))
    found = np.flatnonzero(total == least[row])
    _, at = np.unique(row[found], return_index=True)
    return number[found[at]].astype(np.int32), least // width


def _integers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    made = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
    if np.abs(made).max(initial=0) >= LIMIT:
        raise ValueError(f"a component times {scale:g} is beyond {LIMIT}")
    return made.astype(np.int64)


def kept_vectors(vectors: DataFrame, width: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows whose vectors have `width` components, none null or non-finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.expr(f"size(vector) = {width} and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"))


def first_centroids(kept: DataFrame, k: int, scale: float, seed: int = 1) -> np.ndarray:
    """The k kept vectors of least sha256 of `<seed>:<vec_id>` as integers, in that order; rows of one id by their vectors, null ids last."""
    rows = kept.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("_h"), "vector").limit(k).collect()
    made = [[int(np.floor(scale * x)) for x in r.vector] for r in rows]
    if any(abs(x) >= LIMIT for row in made for x in row):
        raise ValueError(f"a component times {scale:g} is beyond {LIMIT}")
    return np.array(made, dtype=np.int64) if made else np.zeros((0, 0), np.int64)


def assign(kept: DataFrame, centroids: np.ndarray, scale: float) -> DataFrame:
    """(vec_id, cluster, distance decimal(38,0)) of every kept row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = nearest(_integers(batch.column(1), centroids.shape[1], scale), centroids)
                exact = pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0)) if distance.dtype == object else pa.array(distance).cast(pa.decimal128(38, 0))
                yield pa.record_batch([batch.column(0), pa.array(number), exact], names=["vec_id", "cluster", "distance"])

    return mapped(kept, run, "vec_id long, cluster int, distance decimal(38,0)")


def moved(kept: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of each one's vectors; those without any stay.

    Tasks add up their rows, so k rows of a task travel; the driver gets the k x width totals.
    """
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _integers(batch.column(1), width, scale)
            number, _ = nearest(values, centroids)
            if np.abs(values).max(initial=0) > 1 << 40:
                values = values.astype(object)
            for j in np.unique(number):
                own = number == j
                counts[j] += own.sum()
                sums[j] += values[own].sum(axis=0)
        used = np.flatnonzero(counts)
        flat = [[str(x) for x in sums[j]] for j in used]
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(flat, pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    parts = mapped(kept.select("vec_id", "vector"), run, "cluster int, n long, sums array<string>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in totals:
        out[r.cluster, r.at] = int(r.total) // r.n
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, width: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after `rounds` rounds and a last assignment.

    Components x become floor(scale * x), in double precision; those from 2^62 on raise an error. Vectors that are null, of
    another length or with null or non-finite components take no part; repeated rows count each, null ids stay. Fewer than
    k vectors: as many centroids; none: no rows. Extra columns are ignored. `width` must be a power of two, 4 or more.
    """
    if width < 4 or width & (width - 1):
        raise ValueError("width must be a power of two, 4 or more")
    kept = kept_vectors(vectors, width, id_col, vector_col)
    centroids = first_centroids(kept, k, scale, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance decimal(38,0)"), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    return assign(kept, centroids, scale), centroids


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part in clusters().

    Inertias are the distances' sums over the cluster and over all. Numbers that do not fit a long are null.
    """
    found, centroids = clusters(vectors, **options)
    if not len(centroids):
        return found.select("vec_id", "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    found = stored(found, "assigned")
    totals = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    whole = long(sum(totals.values()))
    rows = [(j, long(n), whole, hashlib.sha256(",".join(str(int(x)) for x in centroids[j]).encode()).hexdigest()) for j, n in totals.items()]
    table = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", F.expr("try_cast(distance as long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
