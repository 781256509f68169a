import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import ppm

N = ppm.ORDER


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def sequence(text):
    return [*" ".join(words(text)).encode(), ppm.END]


class Plain:
    def __init__(self, texts):
        self.seen = defaultdict(Counter)
        for t in texts:
            s = [ppm.END] * N + sequence(t)
            for i in range(N, len(s)):
                for k in range(N + 1):
                    self.seen[tuple(s[i - k : i])][s[i]] += 1

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(N, -1, -1):
            node = self.seen.get(tuple(context[N - k :]))
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in excluded}
            n, q = sum(left.values()), len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / (n + q))
            if q:
                out += math.log10(q / (n + q))
            excluded |= set(node)
        return out - math.log10(ppm.SIZE - len(excluded))

    def text(self, text):
        s = [ppm.END] * N + sequence(text)
        return sum(self.log10(s[i - N : i], s[i]) for i in range(N, len(s)))


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    train = [r.text for r in rows if not held[r.doc_id]]
    counts = Counter(w for t in train for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    model = Plain(train)
    got = {r.doc_id: r for r in ppm.scores(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ts, g = [*words(r.text), None], got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(ts), sum(counts[t] > 0 for t in ts), total)
        assert g.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in ts), rel=1e-9)
        if len(r.text) < 3000:
            assert g.score == pytest.approx(model.text(r.text), rel=1e-9)


def test_few_top_words_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in ppm.scores(docs).collect()}
    monkeypatch.setattr(ppm, "TOP", 10)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in ppm.scores(docs).collect()} == want


def test_probabilities_sum_to_one():
    texts = ["the cat sat on the mat", "the hat", "a cat"]
    keys = np.concatenate([ppm_keys(t) for t in texts])
    grams, counts = np.unique(keys, return_counts=True)
    trie = ppm.Trie(grams, counts)
    for context in ([256] * N, [*b"in the"][-N:], [ord("z")] * N, [*b"xxxxca"][-N:], [*b"zs the"][-N:]):
        base = 0
        for symbol in context:
            base = (base + symbol) * 257
        assert (10 ** trie.log10(base + np.arange(257))).sum() == pytest.approx(1)
    assert ppm.Trie(np.zeros(0, np.int64), np.zeros(0)).log10(np.array([5])) == pytest.approx(-math.log10(257))


def ppm_keys(text):
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    low, bounds = ppm.tokens(data, offsets)
    return ppm.canonical(low, offsets, bounds)[0]


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "some text", 5), (6, "word " * 60000, 5), (8, "\tA  b\n", 5), (9, "é", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = ppm.scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (2, 1), (2, 1), (6, 60001), (8, 3), (9, 2)]
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert ppm.scores(docs.limit(0)).count() == 0


def test_rare_contexts_all_count(spark, sf_dir, monkeypatch):
    """Every symbol in context counts however many there are, and however texts and counts are dealt out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r.text) < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Plain([r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2])
    want = {r.doc_id: model.text(r.text) for r in rows}
    for name, value in {"NODES": 1000, "GROUP": 5000, "BUCKETS": 3, "ANSWERS": 20_000}.items():  # NODES was the number of symbols kept
        monkeypatch.setattr(ppm, name, value, raising=False)
    assert {r.doc_id: r.score for r in ppm.scores(docs).collect()} == pytest.approx(want, rel=1e-9)
