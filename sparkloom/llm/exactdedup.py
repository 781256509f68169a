"""Removing byte strings of LENGTH that start earlier, by sorting suffixes where texts can agree.

Not every suffix is moved. Each window of LENGTH bytes has an anchor: the leftmost least-hash gram of GRAM bytes in it,
which equal windows have at the same offset, so only anchors (one in about 35 bytes) are shuffled, by gram. Windows
with one anchor are neighbours; together they cover a span.

1. Anchors whose whole spans are equal (by a 128-bit BLAKE2b of their bytes) are a class: all but the first occurrence
   are repeats (per batch before the shuffle, then per gram), so groups of copies of any size shrink to one row a batch.
2. First occurrences of a gram with several classes agree in part at most. Their spans are fetched, their windows are
   sorted as suffixes by the deep-shallow scheme, and in each run of equal strings the first occurrence stays.
   A gram with more than HOT such spans is split: each span becomes two parts, dealt by the bytes that all windows of such
   a part have in common, and equal parts are told as in step 1. Where more than HOT different parts still agree in those
   bytes, their windows are dealt by their own hash.
3. The removed ranges meet their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunked, mapped, mix, prefix_sums, slice_hashes, stored, text_bytes
from .suffixes import sort_suffixes

LENGTH, GRAM = 100, 32
#: The greatest length of strings that is taken.
LONGEST = 1 << 15
#: Spans of one gram that one task sorts; grams with more are split by window.
HOT = 2_000

_ANCHORS = "kind int, h long, c long, c2 long, doc long, th long, pack long"
_FOUND = "kind int, h long, doc long, th long, pack long"
RANGE, REQUEST, ANCHOR = 0, 1, 2


def digests_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 128-bit BLAKE2b of each slice as two numbers a row: what makes strings equal must not be open to made-up clashes."""
    view, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    made = b"".join([hashed(view[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def gram_size(length: int) -> int:
    """Bytes of the grams that find strings of `length` bytes: a third, at most GRAM."""
    if not 1 <= length <= LONGEST:
        raise ValueError(f"length must be 1 to {LONGEST}")
    return min(GRAM, max(1, length // 3))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, span digest, its other half, row, first window, last window, anchor) of every anchor, places relative to data."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    least = slice_hashes(sums, at, at + gram)
    least = (least >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    reach = 1
    while reach < width:  # least[i] is the least of `reach` places from i
        hop = min(reach, width - reach)
        least = np.minimum(least[:-hop], least[hop:])
        reach += hop
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    if not len(window):
        return none
    place, row = place[window], row[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(fresh)
    first, last = window[heads], window[np.append(heads[1:], len(window)) - 1]
    anchor, row = place[heads], row[heads]
    h = slice_hashes(sums, anchor, anchor + gram)
    c = digests_of(data, first, last + length)
    return h.view(np.int64), c[:, 0], c[:, 1], row, first, last, anchor


def _pack(start, more, offset):
    """One number that sorts by start: start, windows after the first, offset of the anchor from start."""
    return (start << 32) | (more << 16) | offset


def _unpack(pack):
    """(start, windows after the first, offset of the anchor)."""
    return pack >> 32, (pack >> 16) & 0xFFFF, pack & 0xFFFF


def _range(pack, length: int):
    """The range that a span covers: start << 24 | size."""
    start, more, _ = _unpack(pack)
    return (start << 24) | (more + length)


def _firsts(h, c, c2) -> np.ndarray:
    """Which of the sorted rows is the first of its class."""
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
    return first


def _batch(columns, names) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in columns], names=names)


def _anchor_rows(h, c, c2, doc, th, pack, length: int, spans: list[bytes] | None = None) -> pa.RecordBatch:
    """Anchor rows of one batch: the first of each class, and the ranges that all others are; with the firsts' spans, if given."""
    order = np.lexsort((pack, th, doc, c2, c, h))
    first = _firsts(h[order], c[order], c2[order])
    owner = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    again = order[~first & ((doc[order] != doc[owner]) | (th[order] != th[owner]) | (pack[order] != pack[owner]))]
    keep = order[first]
    ranges = _range(pack[again], length)
    one = lambda a, b: np.concatenate([a, b])
    zeros = np.zeros(len(again), np.int64)
    bytes_of = [] if spans is None else [pa.array([spans[i] for i in keep.tolist()] + [None] * len(again), pa.binary())]
    return _batch(
        (one(np.full(len(keep), ANCHOR, np.int32), np.full(len(again), RANGE, np.int32)), one(h[keep], mix(doc[again].astype(np.uint64)).view(np.int64)), one(c[keep], zeros), one(c2[keep], zeros), one(doc[keep], doc[again]), one(th[keep], th[again]), one(pack[keep], ranges), *bytes_of),
        ["kind", "h", "c", "c2", "doc", "th", "pack", *["span" for _ in bytes_of]],
    )


def _classes(rows: DataFrame, length: int) -> DataFrame:
    """Of anchor rows dealt by gram: ranges of all but first occurrences, requests for firsts of grams with several classes."""
    names = ["kind", "h", "doc", "th", "pack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last first-of-class: its row and whether the class before has its gram
        for batch in batches:
            kind, h, c, c2, doc, th, pack = (batch.column(i).to_numpy() for i in range(7))
            passed = kind == RANGE
            if passed.any():
                yield _batch([x[passed] for x in (kind, h, doc, th, pack)], names)
                h, c, c2, doc, th, pack = (x[~passed] for x in (h, c, c2, doc, th, pack))
            if not len(h):
                continue
            if last is not None:
                h, c, c2, doc, th, pack = (np.concatenate([[v], x]) for v, x in zip(last[0], (h, c, c2, doc, th, pack)))
            first = _firsts(h, c, c2)
            owner = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = np.flatnonzero(~first & ((doc != doc[owner]) | (th != th[owner]) | (pack != pack[owner])))
            if len(again):
                yield _batch((np.full(len(again), RANGE, np.int32), h[again], doc[again], th[again], _range(pack[again], length)), names)
            firsts = np.flatnonzero(first)
            before = np.zeros(len(firsts), bool)
            before[1:] = h[firsts[1:]] == h[firsts[:-1]]
            before[0] = last is not None and last[1]
            after = np.append(before[1:], False)
            ask = firsts[:-1][(before | after)[:-1]]
            if len(ask):
                yield _batch((np.full(len(ask), REQUEST, np.int32), h[ask], doc[ask], th[ask], pack[ask]), names)
            i = firsts[-1]
            last = (tuple(x[i] for x in (h, c, c2, doc, th, pack)), bool(before[-1]))
        if last is not None and last[1]:
            h, _, _, doc, th, pack = last[0]
            yield _batch([np.array([x]) for x in (np.int32(REQUEST), h, doc, th, pack)], names)

    return mapped(rows.repartition("h").sortWithinPartitions("kind", "h", "c", "c2", "doc", "th", "pack"), run, _FOUND)


def _with_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts and rows that concern them in one partition, each text after its rows."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in texts.schema if f.name not in ("doc", "th")]
    asked = rows.select("doc", "th", F.lit(0).alias("kind"), "h", "pack", *empty)
    own = texts.select("doc", "th", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("pack"), *[f.name for f in texts.schema if f.name not in ("doc", "th")])
    return asked.union(own).repartition("doc", "th").sortWithinPartitions("doc", "th", "kind", "pack")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, place, h, pack) of every text row with the rows before it that concern it."""
    held: tuple | None = None
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        doc, th, kind, h, pack = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        at = 0
        for i in np.flatnonzero(kind == 1).tolist():
            key = (doc[i], th[i])
            if i > at:
                if held != (doc[at], th[at]):
                    parts = []
                held = (doc[at], th[at])
                parts.append((h[at:i], pack[at:i]))
            if held == key:
                yield batch, i, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            else:
                yield batch, i, h[:0], pack[:0]
            at = i + 1
        if at < len(kind):
            if held != (doc[at], th[at]):
                parts = []
            held = (doc[at], th[at])
            parts.append((h[at:], pack[at:]))


def _spans(texts: DataFrame, requests: DataFrame, length: int) -> DataFrame:
    """(h, doc, th, pack, span): the bytes of every requested span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["h", "doc", "th", "pack", "span"]
        make = lambda: pa.record_batch([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.binary())], names=names)
        for batch, i, h, pack in _runs(batches):
            if not len(h):
                continue
            raw, doc, th = batch.column(5)[i].as_py(), batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for g, p in zip(h.tolist(), pack.tolist()):
                start, more, _ = _unpack(p)
                out.append((g, doc, th, p, raw[start : start + more + length]))
            if len(out) > 20_000:
                yield make()
                out.clear()
        if out:
            yield make()

    return mapped(_with_texts(texts.select("doc", "th", "raw"), requests), run, "h long, doc long, th long, pack long, span binary")


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(bytes, window starts in them, row, starts in the text, offsets of the anchor) of all windows of the spans."""
    data, offsets = text_bytes(batch.column(4))
    start, more, offset = _unpack(batch.column(3).to_numpy())
    count = more + 1
    row = np.repeat(np.arange(len(count)), count)
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return data, offsets[row] + shift, row, start[row] + shift, offset[row] - shift


def _sorted_ranges(spans: DataFrame, length: int) -> DataFrame:
    """Ranges of the windows that have an earlier equal one, from spans dealt by gram."""
    names = ["kind", "h", "doc", "th", "pack"]

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts, row, own, offset = _windows(batch)
        h, doc, th = (batch.column(i).to_numpy() for i in range(3))
        order, group = sort_suffixes(data, starts, length)
        row, own, offset = row[order], own[order], offset[order]
        # equal strings have their anchors at one offset; h parts nothing more, equal strings have equal grams
        by = np.lexsort((own, th[row], doc[row], group))
        row, own, group = row[by], own[by], group[by]
        head = np.ones(len(by), bool)
        head[1:] = group[1:] != group[:-1]
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = (doc[row] != doc[row[lead]]) | (th[row] != th[row[lead]]) | (own != own[lead])
        row, own = row[again], own[again]
        by = np.lexsort((own, row))
        row, own = row[by], own[by]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1] + 1)
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(row))) - 1 + length
        row, own = row[heads], own[heads]
        return _batch((np.full(len(row), RANGE, np.int32), h[row], doc[row], th[row], (own << 24) | size), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            cut = int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])  # where the last gram of the batch begins
            if cut or held and held[-1].column(0)[-1].as_py() != h[0]:
                done = pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held).combine_chunks().to_batches()
                for part in done:
                    yield solve(part)
                held = []
            held.append(batch.slice(cut))
        if held:
            for part in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield solve(part)

    return mapped(spans.repartition("h").sortWithinPartitions("h", "doc", "th", "pack"), run, _FOUND)


def _parts(spans: DataFrame, length: int) -> DataFrame:
    """Anchor rows with bytes: each span as the part whose anchor is far into its windows, and the rest.

    Equal windows have their anchor at one offset, so they are in parts of one kind, and all windows of a part have bytes
    around the anchor in common, by whose hash it is dealt: more than the gram has, so parts of one hot gram go apart.
    """
    gram = gram_size(length)
    half = (length - gram + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            start, more, offset = _unpack(batch.column(3).to_numpy())
            for lo, hi, data, offsets in chunked(batch.column(4)):
                own, count, off, base = start[lo:hi], more[lo:hi] + 1, offset[lo:hi], offsets[:-1]
                turn = np.clip(off - half, 0, count)  # how many windows have the anchor behind `half`
                far, near = np.flatnonzero(turn > 0), np.flatnonzero(turn < count)
                row = np.concatenate([far, near])
                first = np.concatenate([np.zeros(len(far), np.int64), turn[near]])
                last = np.concatenate([turn[far], count[near]]) - 1
                at = base + off
                common = prefix_sums(data), np.concatenate([at[far] - half - 1, at[near]]), np.concatenate([at[far] + gram, at[near] + length - half])
                begin, end = base[row] + first, base[row] + last + length
                c = digests_of(data, begin, end)
                whole = data.tobytes()
                cut = [whole[b:e] for b, e in zip(begin.tolist(), end.tolist())]
                yield _anchor_rows(slice_hashes(*common).view(np.int64), c[:, 0], c[:, 1], doc[lo + row], th[lo + row], _pack(own[row] + first, last - first, off[row] - first), length, cut)

    return mapped(spans, run, f"{_ANCHORS}, span binary")


def _split_ranges(spans: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many spans: windows are dealt by their own 128-bit digest, firsts found as in step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                data, starts, row, own, _ = _windows(batch)
                made = digests_of(data, starts, starts + length)
                doc, th = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                yield _anchor_rows(made[:, 0], made[:, 1], np.zeros(len(row), np.int64), doc[row], th[row], _pack(own, 0, 0), length)

    return _classes(mapped(spans, run, _ANCHORS), length).filter(F.col("kind") == RANGE)


def repeated_ranges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, pack) ranges to remove from texts (doc long, th long, raw binary); pack is start << 24 | size, ranges may overlap."""
    gram = gram_size(length)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunked(batch.column(2)):
                h, c, c2, row, first, last, anchor = anchors(data, offsets, length, gram)
                start = first - offsets[row]
                yield _anchor_rows(h, c, c2, doc[lo + row], th[lo + row], _pack(start, last - first, anchor - first), length)

    found = stored(_classes(mapped(texts.select("doc", "th", "raw"), mark, _ANCHORS), length), "repeats-anchors")
    requests = found.filter(F.col("kind") == REQUEST)
    spans = stored(_spans(texts, requests, length), "repeats-spans")
    few, many = _by_size(spans, "hot")
    parts = stored(_parts(many, length), "repeats-parts")
    told = stored(_classes(parts.drop("span"), length), "repeats-classes")
    asked = told.filter(F.col("kind") == REQUEST).select("h", "doc", "th", "pack")
    fewer, most = _by_size(parts.filter(F.col("kind") == ANCHOR).join(asked, ["h", "doc", "th", "pack"], "left_semi").select(spans.columns), "hot-parts")
    part = stored(_sorted_ranges(few.union(fewer), length).union(_split_ranges(most, length)), "repeats-sorted")
    ranges = [found.filter(F.col("kind") == RANGE), told.filter(F.col("kind") == RANGE), part]
    return reduce(DataFrame.union, ranges).select("doc", "th", "h", "pack")


def _by_size(spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the hashes that have up to HOT, and the others."""
    sizes = spans.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = stored(sizes.filter(F.col("n") > HOT).select("h"), f"repeats-{name}")  # a table of its own: Spark can split the joins' hot keys
    return spans.join(hot, "h", "left_anti").select(spans.columns), spans.join(hot, "h", "left_semi").select(spans.columns)


def merged(pack: np.ndarray) -> list[tuple[int, int]]:
    """Maximal (start, end) runs of ranges sorted by start."""
    if not len(pack):
        return []
    start, end = pack >> 24, (pack >> 24) + (pack & 0xFFFFFF)
    far = np.maximum.accumulate(end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > far[:-1]
    heads = np.flatnonzero(fresh)
    return list(zip(start[heads].tolist(), far[np.append(heads[1:], len(start)) - 1].tolist()))


def _prepared(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(doc, th, raw, rest): doc sorts like the id (null first); th tells rows of one id with different texts apart."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), raw.alias("raw"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("doc")).first()
    return rows.select("doc", (F.lit(0).cast("long") if n == ids else F.xxhash64("raw")).alias("th"), "raw", "rest")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row: what is left after repeats are removed.

    A byte goes if a string of `length` bytes (1 to LONGEST, else an error) over it also starts earlier: in a smaller
    doc_id or before in the text.
    Null texts are empty, null ids come before all others. Repeated rows (id and text) are one document and get equal
    results; rows of one id with different texts are ordered by a hash of the text. Extra columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        make = lambda: pa.record_batch([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.string())], names=names)
        for batch, i, _, pack in _runs(batches):
            raw, runs = batch.column(5)[i].as_buffer() if batch.column(5)[i].is_valid else b"", merged(pack)
            view, kept, at, gone = memoryview(raw), hashlib.sha256(), 0, 0
            for start, end in runs:
                kept.update(view[at:start])
                at, gone = end, gone + end - start
            kept.update(view[at:])
            out.append((batch.column(0)[i].as_py(), len(view), gone, len(runs), kept.hexdigest()))
            if len(out) >= 10_000:
                yield make()
                out.clear()
        if out:
            yield make()

    texts = _prepared(docs, id_col, text_col, []).drop("rest")
    ranges = repeated_ranges(texts, length)
    made = mapped(_with_texts(texts, ranges), cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumn("doc", F.when(F.col("doc") != -(1 << 63), F.col("doc"))).withColumnRenamed("doc", "doc_id")


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without their repeats: text_col has what is left, cut at characters (a partly repeated character stays).

    All other columns are passed on; rows stay even if nothing is left of them. Null texts become empty. See digests().
    """
    rest = [c for c in docs.columns if c != text_col]

    def whole(raw: memoryview, at: int, step: int, stop: int) -> int:
        while at != stop and raw[at] & 0xC0 == 0x80:
            at += step
        return at

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rests = [], []
        for batch, i, _, pack in _runs(batches):
            raw, runs = batch.column(5)[i].as_py(), merged(pack)
            view, kept, at = memoryview(raw), [], 0
            for start, end in runs:
                start = whole(view, start, 1, end)
                end = end if end == len(view) else whole(view, end, -1, start)
                if end > start:
                    kept.append(raw[at:start])
                    at = end
            kept.append(raw[at:])
            out.append(b"".join(kept).decode("utf-8"))
            rests.append(batch.column(6).slice(i, 1))
            if len(out) >= 2_000:
                yield pa.record_batch([pa.array(out, pa.string()), pa.concat_arrays(rests)], names=["text", "rest"])
                out, rests = [], []
        if out:
            yield pa.record_batch([pa.array(out, pa.string()), pa.concat_arrays(rests)], names=["text", "rest"])

    texts = _prepared(docs, id_col, text_col, rest)
    ranges = repeated_ranges(texts.drop("rest"), length)
    kind = texts.schema["rest"].dataType.simpleString()
    made = mapped(_with_texts(texts, ranges), cut, f"text string, rest {kind}")
    return made.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])
