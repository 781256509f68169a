import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm import centroids


def plain(rows, k=16, rounds=3):
    """The same with loops over Python integers."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        mine = [best(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(cs):
            own = [v for (_, v), m in zip(kept, mine) if m == j]
            new.append([sum(x) // len(own) for x in zip(*own)] if own else c)
        cs = new
    found = [(i, *reversed(best(v))) for i, v in kept]
    out = []
    for i, j, d in found:
        sha = hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()
        out.append((i, j, d, sum(x for _, m, x in found if m == j), sum(x for _, _, x in found), sha))
    return sorted(out, key=str)


def report(spark, rows, schema="vec_id long, embedding array<float>"):
    got = centroids.cluster_report(spark.createDataFrame(rows, schema)).collect()
    return sorted([tuple(r) for r in got], key=str)


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-500, 500, (40, 64)), rng.integers(-500, 500, (7, 64))
    assert ((((v[:, None] - c[None]) ** 2).sum(2) * 64) == ((centroids.hadamard(v)[:, None] - centroids.hadamard(c)[None]) ** 2).sum(2)).all()
    assert centroids.sequency(8).tolist() == [0, 4, 6, 2, 3, 7, 5, 1]


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 30])
def test_nearest_is_exact_with_ties(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread + 1, (9, 64))
    c[5] = c[2]
    v = np.concatenate([rng.integers(-spread, spread + 1, (300, 64)), c])
    full = ((v.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
    number, distance = centroids.nearest(v, c)
    assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_table_equals_plain_rounds(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in table.collect()])
    got = sorted([tuple(r) for r in centroids.cluster_report(table).collect()], key=str)
    assert got == want


def test_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, -0.25, 0.0, 0.25, 1e5]) for _ in range(64)]) for i in range(40)]
    rows += rows[:20] + [(None, [0.5] * 64), (None, [0.25] * 64), (50, None), (51, [1.0] * 63), (52, [float("nan")] + [0.0] * 63), (53, [None] + [0.0] * 63), (54, [float("inf")] * 64), (7, [0.0] * 64), (55, [])]
    assert report(spark, rows) == plain(rows)
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")
    assert sorted([tuple(r) for r in centroids.cluster_report(table).collect()], key=str) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert report(spark, rows) == plain(rows)
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []


def test_what_does_not_fit(spark):
    rows = [(i, [float(i) * 2.0**40] * 64) for i in range(20)]
    assert [r[1] for r in report(spark, rows, "vec_id long, embedding array<double>")] == [r[1] for r in plain(rows)]
    with pytest.raises(Exception, match="beyond"):
        report(spark, [(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>"), width=48)
