"""Words that a hash can't tell apart are different words in every operator that keeps words."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkloom.llm import bytebpe, packing, ppm, slices

#: The two Thue-Morse words of 1,024 letters: equal under every polynomial hash modulo 2^64.
MORSE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, MORSE[0]), (2, MORSE[1]), (3, f"{MORSE[1]} and {MORSE[0]} {MORSE[1]}"), (4, MORSE[0])]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=6), st.binary(max_size=3)), max_size=30), st.booleans())
def test_distinct_slices(parts, tiles):
    """Slices with and without bytes between them."""
    words = [w for w, _ in parts]
    data = np.frombuffer(b"".join(w if tiles else w + gap for w, gap in parts), np.uint8)
    start = np.cumsum([0, *(len(w) + len(gap) * (not tiles) for w, gap in parts)])[:-1].astype(np.int64)
    found, inverse = slices.distinct_slices(data, start, start + [len(w) for w in words] if words else start)
    assert [found[i] for i in inverse] == words and len(set(found)) == len(found) == len(set(words))


def test_a_full_cache_starts_anew():
    cache = slices.SliceCache(lambda words: [[len(w)] * len(w) for w in words], limit=1000)
    for k in range(50):
        words = [b"x" * (1 + (k * 7 + i) % 23) for i in range(9)]
        end = np.cumsum([len(w) for w in words])
        ids, size = cache.ids(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
        assert size.tolist() == [len(w) for w in words] and ids.tolist() == [n for n in size for _ in range(n)]
        assert cache.held < 4000


def test_byte_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bytebpe.tokenize(docs, path, digests=True).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id] == (hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r.ids_crc32 for r in packing.text_pieces(docs, path).collect()}
    assert got == {r.doc_id: zlib.crc32(np.array(library.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect()}


@pytest.mark.parametrize("top", [0, 1, 100])
def test_ppm_base(spark, docs, monkeypatch, top):
    monkeypatch.setattr(ppm, "TOP_BYTES", 5000 if top else 64)
    monkeypatch.setattr(ppm, "TOP", max(top, 1))
    got = {r.doc_id: r for r in ppm.scores(docs).collect()}
    train = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts: dict = {}
    for text in train:
        for word in [*text.split(), None]:
            counts[word] = counts.get(word, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    for r in docs.collect():
        words = [*r.text.split(), None]
        assert got[r.doc_id].base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in words), rel=1e-12)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_known) == (len(words), sum(w in counts for w in words))
