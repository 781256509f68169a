"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Every code point gets a class, classes become symbols with one look-ahead, and a small automaton says where a token
starts. Its transitions are functions on states; functions compose associatively, so blocks are reduced side by side,
the blocks' functions scanned by doubling, and the states inside all blocks then followed at once. No regex runs.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunked, mapped
from .slices import SliceCache

LETTER, NUMBER, OTHER, SPACE, JOINED, ALONE, SHORT, LONG = range(8)
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, JOINING, FRESH, ONE_LEFT, TWO_LEFT = range(8)

#: Fixed values of the pre-tokenisation pattern: its white space and its contractions.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    found = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            found[cp] = LETTER if kind == "L" else NUMBER
    found[WHITE] = SPACE
    return found


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by symbol and state."""
    step, starts = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for symbol, into in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        step[symbol] = into
        starts[symbol, [into, JOINING]] = False
    step[SPACE], step[JOINED], step[ALONE] = IN_SPACE, JOINING, FRESH
    starts[SPACE, IN_SPACE] = False
    for symbol, into in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        step[symbol] = into
        step[symbol, [IN_OTHER, JOINING]] = IN_OTHER
        starts[symbol, [IN_OTHER, JOINING]] = False
    step[:, ONE_LEFT], step[:, TWO_LEFT] = FRESH, ONE_LEFT
    starts[:, [ONE_LEFT, TWO_LEFT]] = False
    return step, starts


STEP, STARTS = _tables()
#: Symbols 8 to 15 are those of a text's first code point: whatever the state was, it is as after nothing.
STEP2 = np.concatenate([STEP, np.repeat(STEP[:, [FRESH]], 8, axis=1)])
STARTS2 = np.concatenate([STARTS, np.ones((8, 8), bool)])


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; `first` marks the first ones of texts, which are never looked ahead to."""
    kind = classes()[points]
    n = len(points)
    ahead = np.full(n, 255, np.uint8)
    ahead[:-1] = np.where(first[1:], 255, kind[1:])
    out = kind.copy()
    before_ink = (kind == SPACE) & (ahead != SPACE) & (ahead != 255)
    out[before_ink] = np.where(points[before_ink] == 0x20, JOINED, ALONE)
    quotes = np.flatnonzero((points == 0x27) & (ahead == LETTER))
    if len(quotes):
        one = points[quotes + 1]
        out[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        two = quotes[quotes + 2 < n]
        two = two[~first[two + 2]]
        for a, b in LONG_ENDINGS:
            out[two[(points[two + 1] == ord(a)) & (points[two + 2] == ord(b))]] = LONG
    return out + np.where(first, 8, 0).astype(np.uint8)


def token_starts(points: np.ndarray, first: np.ndarray, block: int = 64) -> np.ndarray:
    """Whether a token starts at each code point."""
    n = len(points)
    lanes = -(-n // block)
    padded = np.zeros(lanes * block, np.uint8)
    padded[:n] = symbols(points, first)
    by_step = np.ascontiguousarray(padded.reshape(lanes, block).T)
    run = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)
    flat = STEP2.ravel()
    for row in by_step:
        run = flat[(row.astype(np.uint16) * 8)[None, :] + run]
    hop = 1
    while hop < lanes:  # run[:, i] becomes the function of all blocks up to i
        run[:, hop:] = np.take_along_axis(run[:, hop:], run[:, :-hop], axis=0)
        hop *= 2
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = run[FRESH, :-1]
    begins, out = STARTS2.ravel(), np.zeros((block, lanes), bool)
    for k, row in enumerate(by_step):
        at = row.astype(np.uint16) * 8 + state
        out[k], state = begins[at], flat[at]
    return out.T.ravel()[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first piece of each text and the total) in bytes of the pieces that merges stay within."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return lead, lead, np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    heads = np.searchsorted(lead, offsets[:-1][offsets[:-1] < offsets[1:]])
    first = np.zeros(len(points), bool)
    first[heads] = True
    start = lead[token_starts(points, first)]
    return start, np.append(start[1:], len(data)), np.searchsorted(start, offsets)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank merges, leftmost first, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 512:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    best = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while best and (low := min(best)) < 1 << 30:
        i = best.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del best[i]
        if i < len(best):
            best[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            best[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pieces, with a heap over a linked list: n log n instead of quadratic."""
    import heapq

    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if part[i] else -1
        if j < 0 or part[i] is not a or part[j] is not b:
            continue
        part[i], part[j] = a + b, b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0 and (r := ranks.get(part[left] + part[after[left]])) is not None:
                heapq.heappush(heap, (r, left, part[left], part[after[left]]))
    return [ranks[p] for p in part if p]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.cache = SliceCache(lambda slices: [merge(s, self.ranks) for s in slices])
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids of all texts in turn, those of text i at bounds[i]:bounds[i+1]."""
        start, end, at = pieces(data, offsets)
        ids, size = self.cache.ids(data, start, end)
        return ids, np.concatenate([[0], np.cumsum(size)])[at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)]


@lru_cache(maxsize=2)
def shared_codec(path: str) -> Codec:
    """One codec for a Python worker, so that slices met in one task are known in the next."""
    return Codec(path)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets) of every row: ids, and the byte where each token starts in the UTF-8 text.

    With digests instead of the arrays: ids_sha256 of the ids as little-endian unsigned 32-bit integers and
    decoded_sha256 of the bytes that decoding the ids gives. Null texts are empty: no ids. Repeated rows and null ids
    stay, other columns are ignored. `path` is read by each Python worker and must exist on every executor.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, offsets array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(1)):
                ids, at = codec.encode(data, offsets)
                counts = pa.array(np.diff(at))
                if digests:
                    raw, size = codec.decode(ids), np.concatenate([[0], np.cumsum(codec.size[ids])])[at]
                    ids = ids.astype("<u4")
                    rows = range(hi - lo)
                    more = [
                        pa.array([hashlib.sha256(ids[at[i] : at[i + 1]].data).hexdigest() for i in rows], pa.string()),
                        pa.array([hashlib.sha256(raw[size[i] : size[i + 1]].data).hexdigest() for i in rows], pa.string()),
                    ]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    places = np.cumsum(codec.size[ids]) - codec.size[ids]
                    places -= np.repeat(offsets[:-1], np.diff(at))
                    bounds = pa.array(at.astype(np.int32))
                    more = [pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(places))]
                    names = ["ids", "offsets"]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), counts, *more], names=["doc_id", "n_tokens", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, schema)


def detokenize(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary): the bytes of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path)
        for batch in batches:
            made = [None if ids is None else codec.decode(np.array(ids, dtype=np.int64)).tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "decoded"])

    return mapped(tokens.select(F.col(id_col).cast("long").alias("doc_id"), ids_col), run, "doc_id long, decoded binary")
