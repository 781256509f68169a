"""Token ids of texts as binary files: concatenated ids whose document boundaries are Elias-Fano codes.

Documents are dealt to ranges of ascending id, tokenized there and written by Spark's own committed writer, so a lost task
leaves nothing behind and any file system that Spark knows will do. A file is a row of blocks; a block stands alone:

    "EFT1", bytes of an id (2 or 4), documents, documents without an id (they come first), ids, the least document id,
    the Elias-Fano code of the documents' ends, that of their ids less the least, the ids (little endian), a newline

Its select structures give a document's place from its number without decoding the rest, in about two bits and the log of
the mean length a document; no table of 64-bit offsets is kept. The newline is what the writer ends each row with.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import chunked, mapped, stored
from .eliasfano import EliasFano, encode
from .slices import Joined, SliceCache, Words

_HEAD = struct.Struct("<4sBxxxIIQq")
#: Ids in a block, about; a longer document stands in one of its own. Blocks in a file.
BLOCK, FILE_BLOCKS = 1 << 20, 16
#: Bytes of distinct slices and their ids that a worker keeps: half a million slices, about.
CACHE = 128 << 20

INK, WHITE, LETTER, DIGIT, APOSTROPHE, HIGH = 0, 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = WHITE
_KIND[[b for b in range(128) if chr(b).isalpha()]] = LETTER
_KIND[[b for b in range(128) if chr(b).isdigit()]] = DIGIT
_KIND[0x27] = APOSTROPHE
_KIND[128:] = HIGH
#: Whether the pre-tokenisation ends a piece between two bytes of these kinds, whatever stands around them.
_CUT = np.zeros((6, 6), bool)
_CUT[INK, [WHITE, LETTER, DIGIT]] = True
_CUT[LETTER, [WHITE, INK, DIGIT, APOSTROPHE]] = True
_CUT[DIGIT, [WHITE, INK, LETTER, APOSTROPHE]] = True
_CUT[[APOSTROPHE, HIGH], WHITE] = True

#: UTF-8 of the white space outside ASCII that the pattern knows, by first byte.
_WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [b"\x80" + bytes([b]) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"], 0xE3: [b"\x80\x80"]}


def _whole_rows(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Rows with white space outside ASCII or a special token: their pieces depend on more than two bytes."""
    raw, found = data.tobytes(), []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            found.append(at)
            at = raw.find(token, at + 1)
    for lead, tails in _WIDE.items():
        for at in np.flatnonzero(data == lead).tolist():
            if any(raw.startswith(t, at + 1) for t in tails):
                found.append(at)
    return np.unique(np.searchsorted(offsets, found, side="right") - 1)


def units(data: np.ndarray, offsets: np.ndarray, special: list[bytes] = ()) -> np.ndarray:
    """Ascending starts of slices that can be tokenized apart; together they are all bytes.

    The pattern of byte-level BPE splits between kinds of characters; a blank belongs to the word behind it, a run of
    white space leaves its last character to what follows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = _CUT.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    white = kind == WHITE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])  # of a run, with something behind it in its text
    cut[last] = True
    cut[last[data[last] != 0x20] + 1] = True
    cut |= edge
    for row in _whole_rows(data, offsets, special).tolist():
        cut[offsets[row] + 1 : offsets[row + 1]] = False
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of many texts by a tokenizer file, each distinct slice encoded once and kept."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        encode = Joined(self.tokenizer, self.special[0].decode()) if self.special else self._plain
        self.cache = SliceCache(Words(self.tokenizer, encode) if Words.fits(self.tokenizer) else encode, CACHE)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def _plain(self, slices: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([s.decode("utf-8") for s in slices], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, their bounds)."""
        start = units(data, offsets, self.special)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ids, size = self.cache.ids(data, start, np.append(start[1:], len(data)))
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)]


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    return Encoder(path)


def block(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """The block of documents in ascending order, those without an id first; `ids` are all their ids."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    above = np.array([i - least for i in known], np.uint64)
    head = _HEAD.pack(b"EFT1", ids.dtype.itemsize, len(doc_ids), len(doc_ids) - len(known), len(ids), least)
    return b"".join([head, encode(np.cumsum(sizes, dtype=np.uint64)), encode(above), ids.tobytes()])


class Block:
    """A block inside a file's content. `end` is where the next one starts."""

    def __init__(self, content, at: int = 0):
        magic, width, self.n, self.n_null, self.n_ids, self.least = _HEAD.unpack_from(content, at)
        if magic != b"EFT1":
            raise ValueError(f"no block of token ids at byte {at}")
        at += _HEAD.size
        self.ends = EliasFano(content, at)
        self.above = EliasFano(content, at + self.ends.size)
        at += self.ends.size + self.above.size
        self.ids = np.frombuffer(content, f"<u{width}", self.n_ids, at)
        self.end = at + width * self.n_ids + 1

    def starts(self) -> np.ndarray:
        """Where each document starts, and the end of the last."""
        return np.concatenate([[0], self.ends.all().astype(np.int64)])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.least + v for v in self.above.all().tolist()]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document; nothing else is decoded."""
        lo, hi = ([0] if i == 0 else []) + self.ends.select(np.arange(max(i - 1, 0), i + 1)).tolist()
        return self.ids[lo:hi]


def blocks(content) -> Iterator[Block]:
    at = 0
    while at < len(content):
        found = Block(content, at)
        yield found
        at = found.end


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each text's ids and `end_id` to files under `path`, in ascending order of ids over the files' names.

    Null and empty texts are the end id alone. Null ids come first; rows of one id go by a hash of the text; repeated rows
    stay, and may be dealt to several files. Other columns are ignored. No rows give files without blocks. A block takes
    memory, at least that of its longest document. `tokenizer` must exist on every executor; special tokens that occur in
    a text are encoded as such, none is added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        kind = np.dtype(f"<u{encoder.width}")
        names: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def cut() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([block(names, sizes, np.concatenate(parts))], pa.binary())], names=["block"])
            names.clear(), sizes.clear(), parts.clear()
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunked(batch.column(1)):
                ids, at = encoder.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id).astype(kind)
                at = at + np.arange(len(at))
                begin = 0
                while begin < hi - lo:
                    stop = int(np.searchsorted(at, at[begin] + BLOCK - held, side="right")) - 1
                    if stop <= begin and names:
                        yield cut()
                        held = 0
                        continue
                    stop = min(max(stop, begin + 1), hi - lo)
                    names += keys[lo + begin : lo + stop]
                    sizes += np.diff(at[begin : stop + 1]).tolist()
                    parts.append(ids[at[begin] : at[stop]])
                    held += int(at[stop] - at[begin])
                    begin = stop
        if names:
            yield cut()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), "_h", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = mapped(dealt, run, "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) of every document in the files under `path`, in no order.

    `start` is the number of ids of all documents before it. A file, some BLOCK * FILE_BLOCKS ids, is read whole by a task.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, at long, part int, file int" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                done = 0
                for one in blocks(content.as_buffer()):
                    starts = one.starts()
                    crc = [zlib.crc32(one.ids[lo:hi].astype("<u4").data) for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist())]
                    columns = [pa.array(one.doc_ids(), pa.int64()), pa.array(np.diff(starts)), pa.array(crc, pa.int64()), pa.array(starts[:-1] + done)]
                    columns += [pa.array(np.full(one.n, x, np.int32)) for x in (part, file)]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(one.ids.astype(np.int32))))
                    yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_crc32", "at", "part", "file", "ids"][: len(columns)])
                    done += one.n_ids

    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("int")
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(number(r"^part-(\d+)-").alias("part"), number(r"-c(\d+)\.").alias("file"), "content")
    found = mapped(files, run, schema)
    found = found if ids else stored(found, "documents")
    sizes = found.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("_before"))
    offsets = sizes.withColumn("_in", before(Window.partitionBy("part").orderBy("file"))).join(parts, "part").select("part", "file", (F.col("_before") + F.col("_in")).alias("_from"))
    start = (F.col("_from") + F.col("at")).alias("start")
    return found.join(offsets, ["part", "file"]).select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if ids else []))
