"""What the two classifiers share: who is held out, labels and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, modulus: int, remainder: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the labelled ids that aren't held out; of repeated labels of an id the greatest counts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    return known.filter(~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text and the columns of ids) of the docs (doc_id, text) whose doc_id is in ids, which must be of bounded size and distinct.

    Of an id that comes with several texts the one of least hash counts, so that a hot id is one row.
    """
    more = [c for c in ids.columns if c != "doc_id"]
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.first(c).alias(c) for c in more])


def bounded(df: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """About `rows` rows at most: all, or those whose id's hash is in the least rows / count share.

    The same rows at every partitioning, and no task or driver ever holds more than the sample itself.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.xxhash64(F.col(id_col), F.lit(11)).bitwiseAND((1 << 63) - 1) < int(rows / n * (1 << 63)))
