import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm import exactdedup
from sparkloom.llm.suffixes import BlindTrie, sort_suffixes


def plain(rows, length):
    """rows: (doc_id, text) in order -> kept bytes and runs."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("shallow", [8, 16, 32])
def test_suffix_order(shallow):
    rng, rand = np.random.default_rng(0), random.Random(0)
    for _ in range(40):
        data = rng.integers(97, 97 + rand.choice([1, 2, 3]), rand.randint(50, 300)).astype(np.uint8)
        length = rand.choice([8, 20, 40])
        starts = rng.permutation(len(data) - length + 1)
        order, group = sort_suffixes(data, starts, length, shallow)
        strings = [data[starts[i] : starts[i] + length].tobytes() for i in order]
        assert strings == sorted(strings)
        assert all((a == b) == (x == y) for a, b, x, y in zip(group, group[1:], strings, strings[1:]))


def test_blind_trie():
    rand = random.Random(1)
    strings = [bytes(rand.choice(b"ab") for _ in range(6)) for _ in range(100)]
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    assert [leaf[0] for leaf in trie.leaves()] == sorted(set(strings))
    assert all(strings[i] == leaf[0] for leaf in trie.leaves() for i in leaf[1])


def results(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_query_equals_brute_force(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(exactdedup, "HOT", hot)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {i: w for (i, _), w in zip(rows, plain(rows, 100))}
    assert sum(w[1] for w in want.values()) > 0
    assert results(exactdedup.digests(docs)) == want


def passages(seed):
    rand = random.Random(seed)
    text = lambda n: "".join(rand.choice("abé ") for _ in range(n))
    shared = [text(rand.choice([90, 100, 101, 130, 260])) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(rand.randint(0, 60)) if rand.random() < 0.6 else rand.choice(shared)[rand.randint(0, 20) :] for _ in range(rand.randint(0, 6))]
        rows.append((i * 3 - 20, "".join(parts) if rand.random() < 0.95 else None))
    rows.append((500, "ab" * 400))
    rows.append((501, "x" * 99))
    rows.append((502, "x" * 300))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(exactdedup, "HOT", 5 if seed == 2 else 20_000)
    rows = passages(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: w for (i, _), w in zip(rows, plain(rows, 100))}
    assert results(exactdedup.digests(docs)) == want


def test_odd_rows(spark):
    rand = random.Random(3)
    other = "".join(rand.choice("abcdef ") for _ in range(400))
    rows = [(1, None, 1), (2, other, 1), (2, other, 1), (None, other[:150], 1), (3, "", 1), (4, "y" + other + "é" * 200, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in exactdedup.digests(docs).collect())
    assert got == [(0, 150, 0), (1, 0, 0), (2, 400, 150), (2, 400, 150), (3, 0, 0), (4, 801, 400 + 398)]
    cut = exactdedup.trimmed(docs)
    assert cut.columns == docs.columns and sorted((r.doc_id or 0, len(r.text), r.n_bytes) for r in cut.collect())[:5] == [(0, 150, 1), (1, 0, 1), (2, 250, 1), (2, 250, 1), (3, 0, 1)]
    assert exactdedup.digests(docs.limit(0)).count() == 0 and exactdedup.trimmed(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    rand = random.Random(9)
    part = lambda n: "".join(rand.choice("abcdefgh é") for _ in range(n))
    shared, run = part(5000), "xy" * 3000
    rows = [(1, part(150_000) + shared + part(150_000)), (2, shared[100:4000] + part(200_000) + shared + run + part(99) + run), (3, run)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exactdedup.digests(docs).collect()}
    assert list(got[i] for i, _ in rows) == plain(rows, 100)
    kept = {r.doc_id: r.text for r in exactdedup.trimmed(docs).collect()}
    assert kept[1] == rows[0][1] or got[1][1] > 0
    assert all(len(kept[i].encode()) >= got[i][0] - got[i][1] for i in kept) and kept[3] == "" and len(kept[2]) < len(rows[1][1]) - 8000


def test_strings_whose_plain_hashes_clash(spark):
    """Two texts for which a sum of byte codes times powers gave one hash: nothing repeats."""
    texts = ["znrc jyi je z oeglxlrwlv i cgo qovlnnsxp trdtk    imz wbv wo ehjp hmmtk  esbtswsdsekpuq ilbil jqzzzz", "znrc jyi je z oeglxlrwlv i cgo qjmrxmdp y es ucbo cgaqvz fcjmlb nygtfg  eteuqwl qmxxpanrrcfdzuvyzzzz"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in exactdedup.digests(docs).collect()) == [(1, 100, 0, 0), (2, 100, 0, 0)]
    assert [r.text for r in exactdedup.trimmed(docs).orderBy("doc_id").collect()] == texts


@pytest.mark.parametrize("length, hot", [(1, 20_000), (2, 3), (8, 20_000), (20, 20_000), (20, 4), (40, 20_000), (100, 4), (300, 20_000), (400, 20_000), (400, 1), (1500, 20_000)])
def test_other_lengths(spark, monkeypatch, length, hot):
    monkeypatch.setattr(exactdedup, "HOT", hot)
    rand = random.Random(length)
    text = lambda n: "".join(rand.choice("abcdé ") for _ in range(n))
    shared = text(3 * length + 9)
    rows = [(1, text(50) + shared), (2, shared[: length + length // 2] + text(40) + shared[length // 3 :]), (3, text(3 * length)), (4, shared), (5, "ab" * length), (6, shared[: length - 1]), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert results(exactdedup.digests(docs, length=length)) == {i: w for (i, _), w in zip(rows, plain(rows, length))}


def test_lengths_that_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length in (0, exactdedup.LONGEST + 1):
        with pytest.raises(ValueError):
            exactdedup.digests(docs, length=length)


def test_spans_of_a_hot_gram_make_two_rows_each(spark, monkeypatch):
    """A passage with other text around it in every document: rows grow with the documents, not with their windows."""
    monkeypatch.setattr(exactdedup, "HOT", 30)
    rand = random.Random(12)
    text = lambda n: "".join(rand.choice("abcdefghij ") for _ in range(n))
    shared = text(80)
    rows = [(i, text(60) + shared + text(60)) for i in range(150)] + [(200 + i, rows_of[5:]) for i, rows_of in enumerate([text(20) + shared + "z" * 40] * 3)]
    made, parts = [], exactdedup._parts

    def counted(spans, length):
        out = parts(spans, length)
        made.append((spans.count(), out.count()))
        return out

    monkeypatch.setattr(exactdedup, "_parts", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(exactdedup.digests(docs)) == {i: w for (i, _), w in zip(rows, plain(rows, 100))}
    assert made[0][0] > 100 and made[0][1] <= 2 * made[0][0]
