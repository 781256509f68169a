"""Near-duplicate texts by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints within `radius` bits are linked and the links' connected components returned. Masks come from the
Hadamard-style construction: bit i has a non-zero vector m(i) of radius + 1 bits, table v keeps the bits with odd
m(i) & v. The vectors of at most `radius` differing bits don't span the space, so some v is orthogonal to all of
them, and in that table the two keys are equal: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, mapped, stored, unsigned
from .components import connected

#: Distinct fingerprints in a bucket up to which they are compared in one task; larger buckets go by flipped bits or blocks.
BUCKET = 400


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit SimHash of one text: majority bits of the XXH64 of its word shingles; no words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, row_col: str | None = None) -> DataFrame:
    """(doc_id, row, fp) of every row, row the column `row_col` or null; a null text counts as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (fingerprint(t.as_py(), words) for t in batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values, pa.int64())], names=["doc_id", "row", "fp"])

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, row long, fp long")


def masks(radius: int = 2, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 signed 64-bit masks that cover every difference of up to `radius` bits."""
    size = (1 << (radius + 1)) - 1
    vector = [i % size + 1 for i in np.random.default_rng(7).permutation(bits).tolist()]
    found = [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def within(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of a bucket's fingerprints the smallest one of its chain of links, by sweeping minima over neighbours."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return values[label]
        label = new


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): edges between distinct fingerprints whose components are those of all pairs within the radius.

    fps has one row per distinct `fp`. Buckets of up to BUCKET fingerprints are compared in their task and give a star
    for each group. In larger buckets two fingerprints are within 2 bits iff they share a value one flip (or none)
    from both, so each is dealt out under its 65 such values and linked to the smallest there. For other radii larger
    buckets are dealt into blocks of about BUCKET, and each two blocks are compared in a task. No bucket is capped.
    """
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    keyed = fps.select("fp", table.alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, ["t", "key"]), "simhash-buckets")

    def star(sets: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sets:
            src, dst = [], []
            for members in pdf["fps"]:
                values = np.sort(np.asarray(members, dtype=np.int64))
                roots = within(values, radius)
                other = roots != values
                src.append(values[other])
                dst.append(roots[other])
            yield pd.DataFrame({"src": np.concatenate([*src, np.zeros(0, np.int64)]), "dst": np.concatenate([*dst, np.zeros(0, np.int64)])})

    def stars(members: DataFrame, *group: str) -> DataFrame:
        return members.groupBy(*group).agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(star, "src long, dst long")

    small = stars(shared.filter(F.col("n") <= BUCKET), "t", "key")
    if radius != 2:
        blocks = F.ceil(F.col("n") / BUCKET)
        own = shared.filter(F.col("n") > BUCKET).withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
        pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        wide = stars(pairs.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")), "t", "key", "a", "b")
    else:
        flips = [F.lit(0).cast("long")] + [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
        hot = shared.filter(F.col("n") > BUCKET).select("fp").distinct()
        flipped = hot.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("via"))
        least = flipped.groupBy("via").agg(F.min("fp").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        wide = flipped.join(least, "via").filter("fp != dst").select(F.col("fp").alias("src"), "dst")
    return small.union(wide).distinct()


def _placed(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, (fp, first, root) of the distinct ones)."""
    rows = stored(rows, "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected(stored(links(distinct.select("fp"), radius), "simhash-links"))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return rows, stored(placed, "simhash-roots")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids last, ties by where the row stands).

    Null texts are empty. Repeated rows are one component, so one of them stays; all columns are passed on as they are.
    Rows get a number and are written first; what is compared and chosen from then on are numbers, and texts move once.
    """
    whole = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole.alias("whole")), "simhash-rows")
    rows, placed = _placed(fingerprints(kept.select("row", "doc_id", F.col(f"whole.c{docs.columns.index(text_col)}").alias("text")), words=words, row_col="row"), radius)
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    chosen = rows.join(placed.select("fp", "root"), "fp").groupBy("root").agg(place.alias("k")).select("k.row")
    return kept.join(chosen, "row", "left_semi").select(*[F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: SimHash, covering tables, components; component_id is the smallest doc_id.

    Null texts are empty (fingerprint 0); a null doc_id stays and never is the smallest, except that a component of
    null ids only has a null component_id. Repeated rows are returned as often as they come. Other columns are ignored.
    """
    rows, placed = _placed(fingerprints(docs, id_col, text_col, words), radius)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str | Column = "fp") -> Column:
    return unsigned(F.col(column) if isinstance(column, str) else column)
