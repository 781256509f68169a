import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkloom.llm import learning, quality, toxicity


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth])


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(rows, labels, "quality") > 0.9


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, labels, "toxic") > 0.85


def test_weights_are_sparse_and_find_the_planted_word():
    rng = np.random.default_rng(0)
    feature, row, label = [], [], []
    for i in range(400):
        bad = i % 4 == 0
        own = np.unique(np.append(rng.integers(100, 5000, 40), 7 if bad else 8))
        feature.append(own)
        row.append(np.full(len(own), i))
        label.append(float(bad))
    w = toxicity.fit_rows(np.concatenate(feature), np.concatenate(row), np.array(label))
    assert w[7] > 0.5 and np.count_nonzero(w[:-1]) < 300


def test_non_negative_risk_separates_from_unlabelled_rows():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (900, quality.FEATURES)), rng.normal(3, 1, (300, quality.FEATURES))
    model = quality.fit(good[:300], np.concatenate([good[300:], bad]), prior=2 / 3, steps=300)
    assert (model.scores(good) > 0.5).mean() > 0.9 and (model.scores(bad) < 0.5).mean() > 0.9


def test_scores_ignore_other_columns_and_handle_odd_rows(spark):
    rows = [(1, None, "x", 3.0), (2, "", "x", 1.0), (2, "", "x", 1.0), (None, "some text here", "y", None), (5, "long " * 50000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(2, 1, 0), (2, None, 1), (5, 0, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        got = scored.collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == 5


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(4)
    rows = [sorted(set(rng.integers(0, 25, 8).tolist())) for _ in range(40)]
    labels = [float(7 in r or 3 in r) for r in rows]
    got = toxicity.fit_rows(np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(labels), epochs=3, seed=3)
    z, n, offset = {}, {}, toxicity.SIZE

    def weight(i):
        s = z.get(i, 0.0)
        if i != offset:
            s = 0.0 if abs(s) <= 8.0 else s - 8.0 * (1 if s > 0 else -1)
        return -s / ((1.0 + n.get(i, 0.0) ** 0.5) / 1.0)

    order = np.random.default_rng(3)
    for _ in range(3):
        for i in order.permutation(len(rows)).tolist():
            own = [*rows[i], offset]
            w = {j: weight(j) for j in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for j in own:
                sigma = ((n.get(j, 0.0) + g * g) ** 0.5 - n.get(j, 0.0) ** 0.5) / 1.0
                z[j], n[j] = z.get(j, 0.0) + g - sigma * w[j], n.get(j, 0.0) + g * g
    want = np.zeros(toxicity.SIZE + 1)
    for j in n:
        want[j] = weight(j)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_toxic_features_are_words_beginnings_pairs_and_skips():
    import pyarrow as pa

    from sparkloom.llm.common import text_bytes

    texts = ["The Quick brown, the QUICK", "", "a", "\N{SNOWMAN} brownish brown"]
    feature, row = toxicity.distinct(*toxicity.hashed(*text_bytes(pa.array(texts))))
    for i, words in enumerate([["the", "quick", "brown", "the", "quick"], [], ["a"], ["\N{SNOWMAN}", "brownish", "brown"]]):
        raw = [w.encode() for w in words]
        want = {("word", w) for w in raw} | {("start", w[:k]) for w in raw for k in toxicity.BEGINNINGS if len(w) > k}
        want |= {("next", *p) for p in zip(raw, raw[1:])} | {("skip", *p) for p in zip(raw, raw[2:])}
        assert (row == i).sum() == len(want)


@pytest.mark.parametrize("prior", [0.2, 0.9])  # the negative part is below zero in some of the steps of the second
def test_fit_equals_plain_non_negative_risk(prior):
    rng = np.random.default_rng(6)
    p, u = rng.normal(0, 1, (12, quality.FEATURES)), rng.normal(0.7, 1.3, (20, quality.FEATURES))
    got, steps, rate, decay = quality.fit(p, u, prior, steps=6), 6, 0.1, 1e-5
    width = quality.BINS + 1
    w, offset = [0.0] * (quality.FEATURES * width), float(np.log(prior / (1 - prior)))
    m, v, turned = [0.0] * (len(w) + 1), [0.0] * (len(w) + 1), 0

    def on(x):
        return [j * width + sum(x[j] >= e for e in got.edges[j]) for j in range(quality.FEATURES)]

    pb, ub = [on(x) for x in p], [on(x) for x in u]
    for step in range(1, steps + 1):
        total = lambda bins: sum(w[b] for b in bins) + offset
        loss = lambda z: float(np.log1p(np.exp(z)))
        slope = lambda z: float(1 / (1 + np.exp(-z)))
        negative = sum(loss(total(b)) for b in ub) / len(ub) - prior * sum(loss(total(b)) for b in pb) / len(pb)
        g_pos, g_neg = [0.0] * (len(w) + 1), [0.0] * (len(w) + 1)
        for b in ub:
            for i in [*b, -1]:
                g_neg[i] += slope(total(b)) / len(ub)
        for b in pb:
            for i in [*b, -1]:
                g_neg[i] -= prior * slope(total(b)) / len(pb)
                g_pos[i] += prior * (slope(total(b)) - 1) / len(pb)
        turned += negative < 0
        g = [a + b for a, b in zip(g_pos, g_neg)] if negative >= 0 else [-b for b in g_neg]
        for i in range(len(w)):
            g[i] += decay * w[i]
        for i, x in enumerate(g):
            m[i], v[i] = 0.9 * m[i] + 0.1 * x, 0.999 * v[i] + 0.001 * x * x
            move = rate * (m[i] / (1 - 0.9**step)) / ((v[i] / (1 - 0.999**step)) ** 0.5 + 1e-8)
            if i < len(w):
                w[i] -= move
            else:
                offset -= move
    assert got.weights == pytest.approx(np.array(w), abs=1e-6) and got.offset == pytest.approx(offset, abs=1e-6)
    assert turned > 0 or prior < 0.5


def test_prior_from_scores():
    rng = np.random.default_rng(8)
    for share in (0.1, 0.5, 0.9):
        good, mixed = rng.normal(2, 1, 4000), np.where(rng.random(4000) < share, rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000))
        assert quality.estimated_prior(good, mixed) == pytest.approx(share, abs=0.06)
    assert quality.estimated_prior(np.zeros(0), np.ones(3)) == 0.5
    assert 0.01 <= quality.estimated_prior(np.ones(3), np.zeros(3)) <= 0.99


def test_a_hot_id_teaches_once(spark):
    rows = [(i, f"good words number {i} stand here", 1, 0) for i in range(40)] + [(i, "zzz!!! 111 bad " * 9, 0, 1) for i in range(40, 60)]
    hot = [(3, f"hot {k % 7} text", 1, 0) for k in range(3000)]
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string, q int, t int")
    labels = docs.select("doc_id", F.col("q").alias("quality"), F.col("t").alias("toxic")).distinct()
    known = F.broadcast(labels.select("doc_id", F.col("quality").alias("label")))
    assert learning.one_text(docs.select("doc_id", "text"), known).count() == 60
    for scored in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        assert scored.count() == 3060
