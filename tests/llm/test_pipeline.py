import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline
from sparkloom.llm import pii, quality, simhash
from sparkloom.llm.common import stored
from test_packing import check
from test_simhash import chains, plain


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    done = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"test-{name}")
        done.append((name, before, docs))
        if name != "packing":
            assert docs.columns == names
    by = {name: (before, after) for name, before, after in done}

    before, after = by["quality"]
    kept = {r.doc_id for r in quality.quality_scores(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() < before.count()
    assert after.exceptAll(before).count() == 0

    before, after = by["near_dedup"]
    roots = chains([(r.doc_id, plain(r.text)) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(roots.values())) and after.exceptAll(before).count() == 0

    before, after = by["passage_dedup"]
    seen = set()
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in sorted(before.collect()):
        raw = r.text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        chars, at = [], 0
        for c in r.text:  # a character goes if all its bytes go
            n = len(c.encode())
            if not all(gone[at : at + n]):
                chars.append(c)
            at += n
        assert texts[r.doc_id] == "".join(chars)

    before, after = by["pii"]
    back = {r.doc_id: r.text for r in pii.pseudonymise(after, corpus_pipeline.PII_KEY, back=True).collect()}
    assert back == {r.doc_id: r.text for r in before.collect()}
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = by["packing"]
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        want |= {(r.doc_id, k // 4096): (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    rows = after.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check(rows, 4096) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_odd_rows_pass_all_stages(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (None, "", None, None, None), (None, "", None, None, None), (3, "a b c " * 4000, "en", "s", 1), (3, "a b c " * 4000, "en", "s", 1), (4, "call +1 (743) 555-3824 now", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stored(stage(spark, frame, sf_dir), f"odd-{name}")
            assert name == "packing" or after.columns == docs.columns
            frame = after if name != "quality" else frame
    kept = simhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [1, 3, 4]
