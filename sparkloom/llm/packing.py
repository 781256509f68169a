"""Best-fit packing of token sequences by minimum bin slack.

Texts become pieces of at most `capacity` tokens (only longer texts are cut). Pieces are dealt at random into groups of
about GROUP; each group fills bin after bin: the longest piece left, then the combination of other lengths that leaves
least room, found by a subset-sum dynamic programme whose states are the bits of one integer. Only the last bin of a
group is likely to stay open, so groups cost about one bin in a thousand and no task ever sees more than its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER_NP, chunked, mapped, stored, word_bounds
from .slices import Joined, SliceCache

#: Pieces in a group, on average.
GROUP = 4096


@lru_cache(maxsize=2)
def word_cache(path: str) -> SliceCache:
    """Ids of white-space-delimited words; no token of this tokenizer spans white space, so words stand alone."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return SliceCache(Joined(Tokenizer.from_file(path), "<|endoftext|>"))


#: ASCII bytes by kind: 1 letters and digits, 2 other printable ones but the apostrophe, 0 all else.
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(0x21, 0x7F) if b != 0x27]] = 2
_KIND[[b for b in range(0x21, 0x7F) if chr(b).isalnum()]] = 1


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A-Z lower-cased bytes, start, end, row) of the slices that are tokenized alone.

    The tokenizer lower-cases, drops white space and never joins an ASCII letter or digit with ASCII punctuation other
    than an apostrophe, so words are cut there too and far fewer are distinct. Special tokens such as <|endoftext|>
    are found before that: where "<|" occurs, texts are cut at white space only and keep their case.
    """
    special = len(data) > 1 and bool(((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any())
    start, end, row = word_bounds(data, offsets)
    if special or not len(start):
        return data, start, end, row
    kind = _KIND[data]
    cut = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2)) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cut = cut[~edge[cut]]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return LOWER_NP[data], start, end, np.searchsorted(offsets, start, side="right") - 1


def text_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's ids followed by end_id.

    Null and empty texts are the end id alone. Repeated rows give repeated pieces; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            for lo, hi, data, offsets in chunked(batch.column(1)):
                data, start, end, row = units(data, offsets)
                ids, size = cache.ids(data, start, end)
                at = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(hi - lo + 1))]
                out: list[list] = [[] for _ in range(5 + keep_ids)]
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, begin in enumerate(range(0, len(own), capacity)):
                        part = own[begin : begin + capacity]
                        for column, value in zip(out, (ids_col[lo + i], piece, begin, len(part), zlib.crc32(part.data), part.astype(np.int32))):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths (descending list) with the largest sum up to `room`, as a list."""
    reach, keep, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            wider = (reach | (reach << length)) & keep
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> room & 1:
            break
    left, found = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            found.append(length)
            left -= length
    return found


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths are 0 to capacity."""
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    counts = {k: len(v) for k, v in stacks.items()}
    left = sorted(counts, reverse=True)
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while left:
        chosen = [left[0]]
        counts[left[0]] -= 1
        if left[0] < capacity:
            chosen += fullest(left, counts, capacity - left[0])
            for length in chosen[1:]:
                counts[length] -= 1
        at = 0
        for length in chosen:
            i = stacks[length].pop()
            bins[i], offsets[i] = n, at
            at += length
        n += 1
        if any(not counts[k] for k in set(chosen)):
            left = [k for k in left if counts[k]]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """pieces and their sequence_id and offset: every sequence holds at most `capacity` tokens, gapless from 0.

    Lengths must be 0 to capacity (a greater one fails; a null counts as 0). Ties and repeated rows are packed each on
    its own. An empty table gives no rows.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = stored(pieces.select(names), "pieces")
    groups = max(1, -(-rows.count() // GROUP))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # by row: equal ones part, too

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf[length_col].fillna(0).to_numpy(np.int64)
        if len(size) and size.max() > capacity:
            raise ValueError(f"a piece of {size.max()} tokens is longer than {capacity}")
        bins, offsets = pack_lengths(size, capacity)
        out = pdf[names].copy()
        out["sequence_id"] = (int(pdf["_group"].iloc[0]) << 32) + bins
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(fill, schema)
