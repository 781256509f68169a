"""From raw documents to packed training sequences: five operators of sparkloom.llm in a row.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. What it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import exactdedup, packing, pii, quality, simhash
from sparkloom.llm.common import stored
from sparkloom.llm.queries import PII_KEY, tokenizer_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more); texts are as they were.

    Null and empty texts are scored like any other and stay or go by their score, as do very long ones, scored whole.
    Repeated rows stay or go together. Without labels or documents there is nothing to learn: every score is 0.5, all stay.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each SimHash component; texts are as they were.

    Null, empty and blank texts have fingerprint 0 and are one component. Of repeated rows one stays; of equal doc_ids the
    row that stands first; null doc_ids stand behind all others. Very long texts are read whole. No rows give no rows.
    """
    return simhash.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; documents stay, if need be with an empty text.

    Null texts become empty. A null doc_id comes before all others; rows of one id and text are one document and lose the
    same; rows of one id with different texts are ordered by a hash of the text. Texts of any length are searched whole.
    """
    return _recounted(exactdedup.trimmed(docs))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by pseudonyms of the same format.

    Null texts stay null, empty ones empty; equal values get equal pseudonyms in all rows, repeated ones included. Very
    long texts are read whole, no row is moved or dropped.
    """
    return _recounted(pii.pseudonymise(docs, PII_KEY).drop("pii"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 4096 tokens, as op6's query gives them.

    Null and empty texts are the end token alone; repeated rows are packed each on its own; a null doc_id stays. Texts of
    more than 4096 tokens are cut into pieces, none is dropped. Sequences are gapless from 0. No rows give no rows.
    """
    return packing.pack(packing.text_pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("pii", pii_pseudonyms), ("packing", best_fit_packing)]

#: SQL has neither the trained classifier, the hashes, the suffix order nor the tokenizer: tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
