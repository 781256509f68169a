import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm.components import connected


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def chains(ids_fps):
    parent = {i: i for i, _ in ids_fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(ids_fps, 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in ids_fps}


def test_masks_cover_every_pair_of_bits():
    table = simhash.masks(2)
    assert len(table) == 7
    for i, j in itertools.combinations(range(64), 2):
        assert any(not (m >> i & 1) and not (m >> j & 1) for m in table)


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id").collect()}
    want = [(r.doc_id, plain(r.text)) for r in docs.select("doc_id", "text").collect()]
    roots = chains(want)
    assert got == {i: (f"{fp:016x}", roots[i]) for i, fp in want}


@pytest.mark.parametrize("bucket", [400, 1])
def test_large_buckets_give_the_same_links(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    values = [0, 1, 3, 7, 15, 0xF0, 0xF0F0, (1 << 63) - 1, -1, -2, 1 << 40, (1 << 40) | 3]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in connected(simhash.links(fps)).collect()}
    want = chains([(v, v & (2**64 - 1)) for v in values])
    assert {v: roots.get(v, v) for v in values} == want


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_large_buckets_give_the_same_links_at_other_radii(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    values = [0, 1, 3, 7, 15, 0xF0, 0xF0F0, (1 << 63) - 1, -1, -2, 1 << 40, (1 << 40) | 3, *((1 << 30) + 37 * i for i in range(20))]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    near = [(a, b) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]
    want = {r.node: r.root for r in connected(spark.createDataFrame(near, "src long, dst long")).collect()}
    assert {r.node: r.root for r in connected(simhash.links(fps, radius)).collect()} == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, " \t\n", "z"), (4, "one", "a"), (5, "ONE", "b"), (None, "a b c d", "c"), (7, " ", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.fp == 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, False, None), (1, True, 1), (2, True, 1), (2, True, 1), (3, True, 1), (4, False, 4), (5, False, 4), (7, False, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_texts_are_read_whole(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(50)) for _ in range(60_000))
    rows = [(1, long), (2, long + " x"), (3, long[::-1]), (4, long.upper())]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id").collect()}
    want = [(i, plain(t)) for i, t in rows]
    roots = chains(want)
    assert got == {i: (f"{fp:016x}", roots[i]) for i, fp in want}


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(7, "a b c d", 1), (5, "A B C D", 2), (5, "A B C D", 2), (None, "a b c d", 3), (None, "other words stand here", 4), (9, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.row for r in got.collect()) == [2, 4, 6]
