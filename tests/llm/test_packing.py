import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from sparkloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 60)
        counts = {k: items.count(k) for k in items}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        assert sum(got) == best and all(got.count(k) <= counts[k] for k in got)


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at or length == 0
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(packing.text_pieces(docs, PATH)).collect()
    library = tokenizers.Tokenizer.from_file(PATH)
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[r.doc_id, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    total = sum(v[1] for v in want.values())
    assert check(rows, 4096) <= -(-total // 4096) + 1


def test_units_equal_the_tokenizer(spark):
    texts = ["It's..'s ''re x'Re5't", "<|endoftext|> A<|startoftext|>b", "A%é %%́a= ̸", " x y", "ΑΣ Σ é"]
    library = tokenizers.Tokenizer.from_file(PATH)
    for text in texts:
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        ids = packing.text_pieces(docs, PATH, keep_ids=True).first().ids
        assert ids == library.encode(text, add_special_tokens=False).ids + [1]


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3), (4, "word " * 9000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = packing.pack(packing.text_pieces(docs, PATH)).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 3), (1, 0, 1), (2, 0, 1), (2, 0, 1), (4, 0, 4096), (4, 1, 4096), (4, 2, 809)]
    check(got, 4096)
    assert packing.pack(packing.text_pieces(docs.limit(0), PATH)).count() == 0


def test_equal_rows_go_to_many_groups(spark):
    pieces = spark.range(40_000).selectExpr("cast(null as long) doc_id", "0 piece", "3L length")
    got = packing.pack(pieces).groupBy((F.col("sequence_id").bitwiseAND(F.lit(-(1 << 32)))).alias("g")).count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 2 * packing.GROUP and sum(r["count"] for r in got) == 40_000
