"""Document fingerprints by I-Match with randomised lexicons, in DataFrame and SQL functions only.

The lexicon is the terms whose document frequency lies in a band of the inverse document frequency. A text's distinct
lexicon terms are sorted; each of SUBSETS random sub-lexicons hashes those of them that it holds. The first keeps all
terms, the others one term in 16 to 256, so that texts of any length have some that hold one or two of their terms, and
likeness (the share of sub-lexicons that agree) falls with the share of terms that differ.

The lexicon's size is bounded by the band, not by the corpus: with T distinct terms in a document on average, at most
T / LEAST terms are in that share of documents. It is sent with the plan as 64-bit term hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions

#: Share of documents that a lexicon term must be in at least, and may be in at most.
LEAST, MOST = 0.004, 0.1
SUBSETS = 32


def rates() -> list[int]:
    """One term in how many each sub-lexicon keeps: the first all, the others 16 to 256."""
    return [1] + [16 << k % 5 for k in range(SUBSETS - 1)]


_TERMS = r"array_distinct(filter(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), t -> t != ''))"


def terms(text: str) -> str:
    """SQL for a text's distinct terms: runs of letters and digits, lower-cased."""
    return _TERMS.format(text=text)


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> list[int]:
    """Hashes of the terms in the band over all rows; a term counts once a document."""
    n = docs.count()
    found = docs.select(F.explode(F.expr(f"transform({terms(f'coalesce({text_col}, \"\")')}, t -> xxhash64(t))")).alias("h"))
    band = found.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= least * n) & (F.col("df") <= most * n))
    return sorted(r.h for r in band.select("h").collect())


def fingerprint(text: str, words: list[int]) -> Column:
    """SQL column: SUBSETS hashes (32 bits each) of a text; 0 where a sub-lexicon holds none of its terms.

    A text without lexicon terms uses all its terms, one without any term its characters.
    """
    held = f"filter({{all}}, t -> xxhash64(t) IN ({','.join(f'{w}L' if w != -(1 << 63) else 'bigint(-9223372036854775808)' for w in words)}))" if words else "filter({all}, t -> false)"
    chosen = f"transform(array({terms(text)}), a -> transform(array({held.format(all='a')}), b -> sort_array(if(size(b) > 0, b, a)))[0])[0]"
    part = f"filter(s, t -> pmod(xxhash64(t, k), array({','.join(map(str, rates()))})[k]) = 0)"
    hashed = f"transform(sequence(0, {SUBSETS - 1}), k -> transform(array({part}), p -> if(size(p) = 0, 0L, xxhash64(p) & 4294967295L))[0])"
    whole = f"transform(sequence(0, {SUBSETS - 1}), k -> xxhash64({text}, k) & 4294967295L)"
    return F.expr(f"transform(array({chosen}), s -> if(size(s) > 0, {hashed}, {whole}))[0]")


def digest(fp: str) -> Column:
    """The fingerprint as 8 hex digits a sub-lexicon."""
    return F.expr(f"array_join(transform({fp}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Share of sub-lexicons that agree among those that hold terms of either text; none: 1 if the fingerprints are equal."""
    used = f"size(filter(zip_with({a}, {b}, (x, y) -> x != 0 or y != 0), u -> u))"
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x = y and x != 0), u -> u))"
    return F.expr(f"case when {used} > 0 then {same} / cast({used} as double) when {a} = {b} then 1.0D else 0.0D end")


def with_next(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """rows (doc_id, text), the derived columns, and next_text, next_<derived>: those of the row with the next doc_id, after the last the first.

    Rows are dealt to ranges of doc_id bounded by quantiles, each range also gets the first row of the range after it,
    and a window inside ranges looks one row ahead: each text moves once. Null ids come first, ties go by text.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("_at", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    dealt = rows.withColumn("_range", F.expr(f"size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c <= _at))") if cuts and cuts[0] > -(1 << 63) else F.lit(0))
    firsts = sorted((r._range, r._at) for r in dealt.groupBy("_range").agg(F.min("_at").alias("_at")).collect())
    if not firsts:
        return rows.drop("_at").withColumns(derived).select("*", *[F.col(c).alias(f"next_{c}") for c in ("text", *derived)])
    heads = spark.createDataFrame([(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))], "_to int, _at long")
    halo = dealt.join(F.broadcast(heads), "_at").withColumn("_range", F.col("_to")).drop("_to")
    one = halo.groupBy("_range").agg(F.min("text").alias("text")).withColumnRenamed("text", "_least")
    halo = halo.join(F.broadcast(one), "_range").filter("text = _least").drop("_least").dropDuplicates(["_range"])
    both = dealt.withColumn("_halo", F.lit(0)).unionByName(halo.withColumn("_halo", F.lit(1))).withColumns(derived)
    ahead = "partition by _range order by _halo, _at, text"
    out = both.select("*", *[F.expr(f"lead({c}) over ({ahead})").alias(f"next_{c}") for c in ("text", *derived)])
    return out.filter("_halo = 0").drop("_halo", "_range", "_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[int] | None = None) -> DataFrame:
    """(doc_id, fp) of every row; null texts are empty. `words` is a lexicon() of another corpus, else that of docs."""
    words = lexicon(docs, text_col) if words is None else words
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", fingerprint("text", words).alias("fp"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones (or all) of
    the next document's. Null texts are empty, null ids come before all others, repeated rows stand side by side, a
    single row is its own next one. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = lexicon(rows)
    paired = with_next(rows, {"fp": fingerprint("text", words)})
    half = "cast(floor(length(text) / 2) as int)"
    paired = paired.withColumn("edited", F.expr(f"concat(left(text, length(text) - {half}), left(next_text, {half}))"))
    made = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint("edited", words).alias("edited_fp"))
    return made.select("doc_id", "n_chars", "edited_sha256", digest("fp").alias("fingerprint"), digest("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
