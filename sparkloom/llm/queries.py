"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bytebpe, centroids, exactdedup, hilbertsearch, imatch, packing, pii, ppm, prefixtrie, quality, simhash, tokenfiles, toxicity
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


#: Key of the registered query; a real job passes its own secret.
PII_KEY = b"sparkloom registered query"


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)
    return made.select("doc_id", "text", F.size("pii").alias("n_replaced"), "pii")


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbertsearch.nearest(_table(spark, sf_dir, "embeddings"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.digests(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.text_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), digests=True)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(_table(spark, sf_dir, "documents"))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_rollup_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.spliced_trie(_table(spark, sf_dir, "conversations"))


def op12_elias_fano_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return tokenfiles.read_tokens(spark, path, ids=False)


def op13_walsh_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_imatch_fingerprints, op2_pii_pseudonyms, op3_hilbert_neighbours, op4_toxicity_ftrl, op5_suffix_dedup, op6_best_fit_packing, op7_byte_bpe, op8_simhash_near_dedup, op9_ppm_scores, op10_quality_pu, op11_rollup_trie, op12_elias_fano_files, op13_walsh_centroids)}
#: Every byte and every 100-byte string as rows: fine for a small table.
_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  b AS (SELECT doc_id, n, i, substr(h, 2 * i - 1, 2) AS x, CASE WHEN i + 99 <= n THEN md5(substr(h, 2 * i - 1, 200)) END AS w FROM d, unnest(range(1, n + 1)) AS t(i)),
  s AS (SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM b),
  c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s),
  e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
  g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
  SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
#: Lloyd's rounds over exact integers, all distances of all pairs of vector and centroid.
_NEAREST = "SELECT x.vec_id, x.n, x.v, c.k, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept x, c{0} c"
_ROUND = """a{0} AS (SELECT n, v, arg_min(k, d * 16 + k) AS k FROM (""" + _NEAREST + """) GROUP BY n, v),
  u{0} AS (SELECT k, i, (s - ((s % m) + m) % m) // m AS x FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS m FROM a{0}, unnest(range(1, 65)) AS t(i) GROUP BY k, i)),
  c{1} AS (SELECT c.k, coalesce(w.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT k, list(x::HUGEINT ORDER BY i) AS v FROM u{0} GROUP BY k) w ON c.k = w.k)"""
_CENTROIDS = f"""WITH kept AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < 16),
  {", ".join(_ROUND.format(i, i + 1) for i in range(3))},
  f AS (SELECT n, vec_id, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM ({_NEAREST.format(3)}) GROUP BY n, vec_id)
  SELECT vec_id, f.k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c3 c ON f.k = c.k"""
#: Every prefix as a list. SQL has no crc32: it is folded bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_TRIE = f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, s, {_CRC} % 6 AS h FROM o), b AS (SELECT h.conv_id, coalesce(list_slice(o.s, 1, h), []) || coalesce(list_slice(h.s, h + 1, len(h.s)), []) AS s FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
  p AS (SELECT conv_id, s, d, list_slice(s, 1, d) AS x FROM b, unnest(range(0, len(s) + 1)) AS t(d)),
  n AS (SELECT x, d, min(conv_id) AS conv_id, count(*) AS m, coalesce(string_agg(CASE WHEN len(s) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS e FROM p GROUP BY x, d),
  c AS (SELECT list_slice(x, 1, d - 1) AS x, count(*) AS k FROM n WHERE d > 0 GROUP BY 1), w AS (SELECT n.*, coalesce(k, 0) AS k, CASE WHEN d > 0 THEN (m - 1) * length(n.x[d].t) ELSE 0 END AS v FROM n LEFT JOIN c ON n.x = c.x),
  u AS (SELECT list_slice(x, 1, a) AS x, sum(v)::BIGINT AS saved, count(*) FILTER (k = 0) AS leaves FROM w, unnest(range(0, d + 1)) AS t(a) GROUP BY 1)
  SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.m AS n_convs, w.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(w.e) AS ends_sha256
  FROM w JOIN u ON w.x = u.x LEFT JOIN w q ON w.d > 0 AND q.x = list_slice(w.x, 1, w.d - 1)"""
ORACLE_SQL: dict[str, str] = {"op11_rollup_trie": _TRIE, "op5_suffix_dedup": _REPEATS, "op13_walsh_centroids": _CENTROIDS}
