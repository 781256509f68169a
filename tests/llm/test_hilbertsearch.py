import itertools

import numpy as np
import pytest

from sparkloom.llm import hilbertsearch


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbertsearch.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k, every):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-score[j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(x)] for q, x in out.items()}


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got = results(hilbertsearch.nearest(df))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    true = {(q, v): s for q, x in want.items() for v, s in x}
    assert all(abs(true[q, v] - s) < 1e-12 for q, x in got.items() for v, s in x if (q, v) in true)


def test_slices_and_the_curves_that_go_first_change_nothing(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = results(hilbertsearch.nearest(df))
    monkeypatch.setattr(hilbertsearch, "SLICE", 3)
    monkeypatch.setattr(hilbertsearch, "FIRST", 1)
    assert results(hilbertsearch.nearest(df)) == want


def test_a_sample_places_the_ends_as_well(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    monkeypatch.setattr(hilbertsearch, "SAMPLE", 1000)
    assert recall(results(hilbertsearch.nearest(df)), want) >= 0.9


def test_copies_norms_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6)) * rng.uniform(0.2, 3, (120, 1))
    x[10:70] = x[5]
    rows = [(int(i), [float(v) for v in np.float32(e)]) for i, e in enumerate(x)]
    bad = [(200, None), (220, [0.0] * 6), (240, [float("nan")] + [1.0] * 5), (260, [None] + [1.0] * 5), (280, [float("inf")] * 6), (None, [1.0] * 6), (320, [])]
    df = spark.createDataFrame([(i, e, 0) for i, e in [*rows, *bad, (300, [1.0])]], "vec_id long, embedding array<float>, rank int")
    got, want = results(hilbertsearch.nearest(df)), brute([*rows, (300, [1.0] + [0.0] * 5)], 20, 20)  # a short vector is followed by zeros
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert results(hilbertsearch.nearest(df)) == {20: [(3, 0.5)]}
    assert hilbertsearch.nearest(df.limit(0)).count() == 0
