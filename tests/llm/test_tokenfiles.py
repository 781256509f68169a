import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from sparkloom.llm import eliasfano, tokenfiles
from sparkloom.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def folder(spark):
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 513, 5000])
@pytest.mark.parametrize("top", [0, 1, 700, 10**6, 2**40, 2**64 - 1])
def test_codes_come_back(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    code = eliasfano.encode(values)
    found = eliasfano.EliasFano(b"before" + code + b"after", 6)
    assert found.size == len(code) and (found.all() == values).all()
    picked = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert (found.select(picked) == values[picked]).all()
    if n == 5000:  # two bits a value and the low ones, the directory and the last 512 bits
        assert len(code) * 8 <= n * (2 + max(0, (top // n).bit_length() - 1)) * 1.07 + 1500
    with pytest.raises(IndexError):
        found.select([n])
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


def test_units_never_change_the_ids(library):
    rnd = random.Random(7)
    alphabet = ["a", "b", "It", "'", "'s", "'re", " ", " ", "  ", "\n", "\t", "\r\n", "1", "23", ".", ",", "-", "\u00e9", "\u00df", "\u65e5", "\u0301", "\x1c", "\x00", "<|", "\u2019", "\U0001f600"]
    alphabet += ["\u00a0", "\u3000", "\u2003", "\x85", "\u2028", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet[: rnd.choice([6, 17, 26, 32])]) for _ in range(rnd.randint(0, 12))) for _ in range(6000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, at = tokenfiles.Encoder(PATH).encode(data, offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def want(library, rows):
    """(doc_id, start, n_tokens, crc) of rows in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_table_equals_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = folder(spark)
    tokenfiles.write_tokens(docs.repartition(7), PATH, path)
    expected = want(library, sorted((r.doc_id, r.text) for r in docs.collect()))
    rows = tokenfiles.read_tokens(spark, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expected
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    again = tokenfiles.read_tokens(spark, path, ids=False)
    assert again.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, again.collect())) == expected


def test_one_document_without_the_rest(spark, library):
    docs = spark.createDataFrame([(i * 10**15, "word " * i) for i in range(50)], "doc_id long, text string").coalesce(1)
    path = folder(spark)
    tokenfiles.write_tokens(docs, PATH, path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect() if r.length]
    found = [(b.doc_ids()[i], b.document(i).tolist()) for f in files for b in tokenfiles.blocks(f) for i in range(b.n)]
    assert found == [(i * 10**15, [*library.encode("word " * i, add_special_tokens=False).ids, 0]) for i in range(50)]
    with pytest.raises(ValueError):
        next(tokenfiles.blocks(b"x" * 100))


def test_small_blocks_and_files(spark, library, monkeypatch):
    rnd = random.Random(2)
    rows = [(rnd.randint(-(2**62), 2**62), "x y\n" * rnd.choice([0, 1, 5, 300])) for _ in range(120)]
    names = [b"EFT1"]
    monkeypatch.setattr(tokenfiles, "FILE_BLOCKS", 1)
    # the task's function carries the module by reference: small blocks come from documents longer than a block
    docs = spark.createDataFrame(rows + [(5, "one two " * 600_000)], "doc_id long, text string").coalesce(1)
    path = folder(spark)
    tokenfiles.write_tokens(docs, PATH, path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    assert len(files) >= 3 and all(f[:4] in names and len(list(tokenfiles.blocks(f))) == 1 for f in files)
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, path, ids=False).collect()))
    assert got == sorted(want(library, sorted(rows + [(5, "one two " * 600_000)])))


def test_odd_rows(spark, library):
    rows = [(None, "b"), (None, None), (3, ""), (3, ""), (-4, None), (2**63 - 1, "z"), (-(2**63), "a <|endoftext|>  c"), (7, "it's  x")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, part int")
    path = folder(spark)
    tokenfiles.write_tokens(docs, PATH, path)
    got = sorted(map(tuple, tokenfiles.read_tokens(spark, path, ids=False).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i or 0))
    assert {r[1] for r in got} == {sum(x[2] for x in got[:k]) for k in range(len(got))}
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((i is not None, i or 0, n, c) for (i, _, n, c) in want(library, rows))
    empty = folder(spark)
    tokenfiles.write_tokens(docs.limit(0), PATH, empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0 and tokenfiles.read_tokens(spark, empty, ids=False).count() == 0


def test_same_row_in_many_ranges(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "'same text' text")
    path = folder(spark)
    tokenfiles.write_tokens(docs, PATH, path)
    got = tokenfiles.read_tokens(spark, path, ids=False)
    each = got.first().n_tokens
    assert [r.start for r in got.orderBy("start").collect()] == [each * i for i in range(4000)]


def test_words_go_straight_to_the_model(library):
    """Slices of one piece take the library's model alone, with the same ids; whatever the pattern may part does not."""
    encoder = tokenfiles.Encoder(PATH)
    plain = ["word", " Word", "7", " 2024", "größe", " ÈONAI", " Привет"]
    odd = [" 12a", "don't", " x1", "e\u0301", "\u0660", "\u2160", " ", "  a", "\n", "\u1c89", "\U00010570", "a\u00b2", "<|endoftext|>", "'s", "\u00a0a", "…", "中文"]
    seen, rest = [], encoder.cache.encode.rest
    encoder.cache.encode.rest = lambda slices: seen.extend(slices) or rest(slices)
    mixed = [s.encode() for pair in zip(plain * 3, odd) for s in pair]
    flat, size = encoder.cache.encode(mixed)
    want = [library.encode(s.decode(), add_special_tokens=False).ids for s in mixed]
    assert flat.tolist() == [i for ids in want for i in ids] and size.tolist() == list(map(len, want))
    assert seen == [s.encode() for s in odd]
