import hashlib
import re
import struct
import unicodedata

import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import imatch


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def h64(*parts):
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else struct.pack("<i", p)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def terms(text):
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", text.lower()) if t))


def plain(text, words):
    every = terms(text)
    chosen = sorted([t for t in every if h64(t) in words] or every, key=lambda t: t.encode())
    out = []
    for k in range(imatch.SUBSETS):
        if not chosen:
            out.append(h64(text, k) & 0xFFFFFFFF)
            continue
        part = [t for t in chosen if h64(t, k) % imatch.rates()[k] == 0]
        out.append(h64(*part) & 0xFFFFFFFF if part else 0)
    return "".join(f"{v:08x}" for v in out)


def like(a, b):
    xs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    used = [(x, y) for x, y in xs if (x, y) != ("0" * 8, "0" * 8)]
    return sum(x == y for x, y in used) / len(used) if used else float(a == b)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    count = {}
    for _, text in rows:
        for t in terms(text):
            count[t] = count.get(t, 0) + 1
    words = {h64(t) for t, n in count.items() if imatch.LEAST * len(rows) <= n <= imatch.MOST * len(rows)}
    assert set(imatch.lexicon(docs)) == words
    got = {r.doc_id: r for r in imatch.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    fps = [plain(t, words) for _, t in rows]
    for i, (doc_id, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        r, fp = got[doc_id], plain(edited, words)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fps[i], fp), doc_id
        assert abs(r.near_edited - like(fps[i], fp)) < 1e-9 and abs(r.near_next - like(fps[i], fps[(i + 1) % len(rows)])) < 1e-9


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = imatch.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (2, "", 9), (None, "alpha beta", 9), (7, "!!! ???", 9), (9, "word " * 30000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = imatch.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 10), (1, 0), (2, 0), (2, 0), (7, 7), (9, 150000)]
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0
    one = imatch.edited_fingerprints(docs.filter("doc_id = 7")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"!!! !!!").hexdigest()
