import hashlib
import struct

import pytest
from hypothesis import given, settings, strategies as st

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

import numpy as np
import pyarrow as pa

from sparkloom.llm import bytebpe
from sparkloom.llm.common import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
CODEC = bytebpe.Codec(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB '\n\tsrevldtm1,é中 \U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_ids_equal_the_library(texts):
    data, offsets = text_bytes(pa.array(texts))
    ids, at = CODEC.encode(data, offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids).tobytes() == "".join(texts).encode()


def test_long_pieces_merge_like_short_ones():
    for piece in (b"ab" * 40, b"x" * 100, b"The quick brown fox"):
        if piece not in CODEC.ranks:
            assert bytebpe.merge_long(piece, CODEC.ranks) == bytebpe.merge(piece, CODEC.ranks)
    assert bytebpe.merge(b"zq" * 2000, CODEC.ranks) == LIBRARY.encode_ordinary("zq" * 2000)


def test_round_trip_and_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "It's  a\ttest", 1), (2, "It's  a\ttest", 1), (None, "é", 2), (5, "word " * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    tokens = bytebpe.tokenize(docs, PATH)
    got = sorted((r.doc_id or 0, r.n_tokens, list(r.ids)) for r in tokens.collect())
    assert got == sorted((i or 0, len(LIBRARY.encode_ordinary(t or "")), LIBRARY.encode_ordinary(t or "")) for i, t, _ in rows)
    back = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in bytebpe.detokenize(tokens, PATH).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    first = tokens.filter("doc_id = 2 and n_tokens > 0").first()
    assert first.offsets == [0, 2, 4, 5, 7, 8][: len(first.offsets)]
    assert bytebpe.tokenize(docs.limit(0), PATH, digests=True).count() == 0


def test_digests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.tokenize(docs, PATH, digests=True).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
