"""Language-model scores by prediction by partial matching over bytes.

A pretrained trie of byte contexts up to ORDER bytes gives every symbol's code length: the longest context that knows
the symbol predicts it, each longer one adds its escape (method C: q / (n + q) for q distinct symbols of n), and what
longer contexts know is excluded from the counts of shorter ones. Texts are scored as their lower-cased words joined by
one space, then an end symbol. A unigram model over the same words with add-one smoothing is the base score.

Every training row and every symbol in context counts. The counts stay a table, dealt out by the last two symbols of the
context, so that each bucket of it holds whole tries of all longer contexts; the counts in contexts of at most one symbol,
SIZE * SIZE at most, are sent to the tasks. Groups of texts ask the buckets for the code lengths of their distinct symbols;
the counts of buckets that are asked much are copied, so that no task answers more than its share.
Word counts, by the words' bytes, stay a table too: the TOP most frequent are sent along, all others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER_NP, SPACE, alike, chunked, mapped, partitions, stored, text_bytes, word_bounds
from .learning import held_out

#: Frequent words that are sent along, and their greatest length in bytes.
ORDER, TOP, TOP_BYTES = 5, 100_000, 64  # canonical() takes an odd ORDER
#: Bytes of text that ask together, buckets of the counts at least, and counts in a bucket, about, where there are more.
GROUP, BUCKETS, BUCKET_ROWS = 16 << 20, 509, 200_000
#: Bytes of questions (1 to 3 a symbol), about, that one copy of a bucket's counts answers; buckets that are asked more are copied.
ANSWERS = 4 << 20
#: Symbols are the bytes and the end, which also stands before a text's first byte in contexts.
END, SIZE = 256, 257
#: The token that ends a text; words are never empty.
END_TOKEN = b""
_FLUSH = 2_000_000
#: Rows of a block of texts at most: a key and a row's number share 63 bits.
ROWS = 1 << 14


def canonical(data: np.ndarray, offsets: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the key of every symbol in turn: ORDER symbols of context and itself as one number in base SIZE, symbols of each row)."""
    start, end, row = bounds
    later = np.zeros(len(start), bool)
    later[1:] = row[1:] == row[:-1]
    gaps = start[later] - 1  # of the blanks between two words one counts
    inside = ~SPACE[data]
    inside[gaps] = True
    data = data.copy()
    data[gaps] = 0x20
    size = np.bincount(row, end - start + later, len(offsets) - 1).astype(np.int64)
    ends = np.cumsum(size + ORDER + 1) - 1
    own = np.ones(ends[-1] + 1 if len(ends) else 0, bool)
    for k in range(ORDER):
        own[ends - size - ORDER + k] = False
    letters = own.copy()
    letters[ends] = False
    stream = np.full(len(own), END, np.int32)
    stream[letters] = data[inside]
    pair = stream[1:] + stream[:-1] * SIZE  # two symbols as a number; three such pairs are a key
    key = pair[:-4].astype(np.int64)
    for later_pair in (pair[2:-2], pair[4:]):
        key *= SIZE**2
        key += later_pair
    return key[own[ORDER:]], size + 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(lower-cased bytes, word bounds)."""
    data = LOWER_NP[data]
    return data, word_bounds(data, offsets)


def distinct_words(data: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """(the distinct words, the number of each word among them), by their bytes."""
    start, end, _ = bounds
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    letters = data[~SPACE[data]]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    letters, ends = text_bytes(words.dictionary)
    raw = letters.tobytes()
    return [raw[s:e] for s, e in pairwise(ends.tolist())], words.indices.to_numpy().astype(np.int64)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def distinct(keys: np.ndarray, kind: str | None = None) -> np.ndarray:
    """The distinct keys in order. Sorted numbers are much faster here than the hash table of np.unique."""
    keys = np.sort(keys, kind=kind)
    return keys[firsts(keys)]


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # keys are sorted runs, one behind the other
    keys = keys[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(counts[order], first).astype(np.int64) if len(keys) else np.zeros(0, np.int64)


def count(rows: DataFrame) -> DataFrame:
    """(word, key, n): how often each token (word, its bytes) and each symbol in context (word null, key) occurs in rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}
        symbols: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if symbols:
                keys, n = _sum_by_key(np.concatenate([k for k, _ in symbols]), np.concatenate([c for _, c in symbols]))
                yield pa.record_batch([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], names=["word", "key", "n"])
                symbols.clear()
            if words:
                yield pa.record_batch([pa.array(words.keys(), pa.binary()), pa.array(np.zeros(len(words), np.int64)), pa.array(words.values(), pa.int64())], names=["word", "key", "n"])
                words.clear()

        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(0)):
                data, bounds = tokens(data, offsets)
                found, inverse = distinct_words(data, bounds)
                for word, n in zip(found, np.bincount(inverse, minlength=len(found)).tolist()):
                    words[word] = words.get(word, 0) + n
                words[END_TOKEN] = words.get(END_TOKEN, 0) + hi - lo
                symbols.append(np.unique(canonical(data, offsets, bounds)[0], return_counts=True))
                held += len(symbols[-1][0]) + 4 * len(found) + sum(map(len, found)) // 16
                if held > _FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return mapped(rows.select("text"), run, "word binary, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Arrays of a fixed PPM model; grams are (context, symbol) keys of the deepest level with their counts.

    With `low`, the (key, count) of the whole corpus in contexts of one symbol, grams are those of some buckets only.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(grams)
        keys, n = grams[order].astype(np.int64), counts[order].astype(np.float64)
        self.keys, self.count, self.node, self.total, self.kinds = [], [], [], [], []
        for level in range(ORDER, -1, -1):  # level: bytes of context
            if level == 1 and low is not None:
                keys, n = low
            elif level < ORDER:
                keys, n = _sum_by_key(keys % SIZE ** (level + 1), n)
            node, first = np.unique(keys // SIZE, return_index=True)
            self.keys.insert(0, keys)
            self.count.insert(0, n)
            self.node.insert(0, node)
            self.total.insert(0, np.add.reduceat(n, first) if len(n) else np.zeros(0))
            self.kinds.insert(0, np.diff(np.append(first, len(keys))))
        # what a node's symbols have in its shorter context: left out there
        self.shared = [np.zeros(0)]
        for level in range(1, ORDER + 1):
            below = self.count[level - 1][np.searchsorted(self.keys[level - 1], self.keys[level] % SIZE**level)]
            owner = np.searchsorted(self.node[level], self.keys[level] // SIZE)
            self.shared.append(np.bincount(owner, below, len(self.node[level])))

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
        return at, (sorted_keys[at] == wanted) if len(sorted_keys) else np.zeros(len(wanted), bool)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol in its context."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        less_n, less_q = np.zeros(len(keys)), np.zeros(len(keys))  # what the longer context excludes
        for level in range(ORDER, -1, -1):
            own = keys[open_] % SIZE ** (level + 1)
            node, seen = self._find(self.node[level], own // SIZE)
            at, hit = self._find(self.keys[level], own)
            hit &= seen
            n, q = np.zeros(len(open_)), np.zeros(len(open_))
            if len(self.node[level]):
                n, q = np.where(seen, self.total[level][node] - less_n[open_], 0), np.where(seen, self.kinds[level][node] - less_q[open_], 0)
            if hit.any():
                out[open_[hit]] += np.log10(self.count[level][at[hit]] / (n[hit] + q[hit]))
            escape = ~hit & seen & (q > 0)
            out[open_[escape]] += np.log10(q[escape] / (n[escape] + q[escape]))
            if level and len(self.node[level]):
                less_n[open_] = np.where(seen, self.shared[level][node], 0)
                less_q[open_] = np.where(seen, self.kinds[level][node], 0)
            open_ = open_[~hit]
        out[open_] -= np.log10(SIZE - (self.kinds[0][0] if len(self.kinds[0]) else 0))
        return out


def packed(*columns: pa.Array) -> bytes:
    """Columns of one length as compressed bytes: what travels between tasks."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch(list(columns), names=[str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: pa.Scalar) -> list[pa.Array]:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch().columns


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys symbol by symbol: the last of a bucket's contexts are nearly constant and the first ones ascend."""
    return packed(*[pa.array((keys // SIZE**k % SIZE).astype(np.uint16)) for k in range(ORDER + 1)])


def unpacked_keys(blob: pa.Scalar) -> np.ndarray:
    return sum(c.to_numpy().astype(np.int64) * SIZE**k for k, c in enumerate(unpacked(blob)))


def packed_logs(logs: np.ndarray) -> bytes:
    """Code lengths as they are, but equal ones once."""
    return packed(pa.array(logs).dictionary_encode())


def unpacked_logs(blob: pa.Scalar) -> np.ndarray:
    coded = unpacked(blob)[0]
    return coded.dictionary.to_numpy()[coded.indices.to_numpy()]


def asking(rows: DataFrame, buckets: int) -> DataFrame:
    """(grp, part, bucket, blob): blocks of the rows (_row, doc_id, text) of each group (part 1), and its distinct symbols by bucket (part 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, group = [], 0, None

        def made(part: int, found: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
            n = len(blobs)
            return pa.record_batch([pa.array(np.full(n, group)), pa.array(np.full(n, part, np.int32)), pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], names=["grp", "part", "bucket", "blob"])

        def flush() -> pa.RecordBatch:
            keys = distinct(np.concatenate(parts), "stable")  # merges sorted parts
            bucket = keys // SIZE % SIZE**2 % buckets
            order = np.argsort(bucket, kind="stable")
            keys, (found, first) = keys[order], np.unique(bucket[order], return_index=True)
            return made(0, found, [packed_keys(keys[lo:hi]) for lo, hi in pairwise([*first.tolist(), len(keys)])])

        for batch in batches:
            for lo, hi, data, offsets in chunked(batch.column(2)):
                if group is None:
                    group = batch.column(0)[lo].as_py()
                data, bounds = tokens(data, offsets)
                parts.append(distinct(canonical(data, offsets, bounds)[0]))
                held += len(data)
                for at in range(lo, hi, ROWS):
                    yield made(1, np.full(1, -1), [packed(*batch.slice(at, min(hi - at, ROWS)).columns)])
                if held > GROUP:
                    yield flush()
                    parts, held, group = [], 0, None
        if parts:
            yield flush()

    return mapped(rows, run, "grp long, part int, bucket int, blob binary")


def answered(asked: DataFrame, grams: DataFrame, buckets: int) -> DataFrame:
    """(grp, blob, logs): the symbols of each (grp, bucket, blob) and their log10 probabilities after the counts (key, n)."""
    short = F.col("key") % SIZE**2
    table = grams.groupBy(short.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # at most SIZE * SIZE rows
    low = asked.sparkSession.sparkContext.broadcast((np.asarray(table["key"], dtype=np.int64), np.asarray(table["n"], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, trie = None, [], None
        for batch in batches:
            for lo, hi in alike(batch.column(0), batch.column(1), batch.column(2).is_null().cast(pa.int8())):
                own, copy, grp, key, n, blob = batch.slice(lo, hi - lo).columns
                if (own[0].as_py(), copy[0].as_py()) != bucket:
                    bucket, held, trie = (own[0].as_py(), copy[0].as_py()), [], None
                if grp.null_count:  # counts come first
                    held.append((key.to_numpy(), n.to_numpy()))
                    continue
                if trie is None:
                    keys, counts = zip(*held) if held else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
                    trie, held = Trie(np.concatenate(keys), np.concatenate(counts), low.value), []
                logs = [packed_logs(trie.log10(unpacked_keys(x))) for x in blob]
                yield pa.record_batch([grp, blob, pa.array(logs, pa.binary())], names=["grp", "blob", "logs"])

    copies = F.least(F.ceil(F.sum(F.octet_length("blob")) / ANSWERS), F.lit(1 << 20)).cast("int").alias("copies")
    asked_of = F.broadcast(stored(asked.groupBy("bucket").agg(copies), "ppm-copies"))  # at most `buckets` rows
    bucket = F.expr(f"cast((key div {SIZE}) % {SIZE**2} % {buckets} as int)").alias("bucket")
    counts = grams.select(bucket, "key", "n").join(asked_of, "bucket").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    asks = asked.join(asked_of, "bucket").withColumn("copy", F.pmod(F.xxhash64("grp"), F.col("copies")).cast("int"))
    both = counts.select("bucket", "copy", F.lit(None).cast("long").alias("grp"), "key", "n", F.lit(None).cast("binary").alias("blob"))
    both = both.union(asks.select("bucket", "copy", "grp", F.lit(None).cast("long"), F.lit(None).cast("long"), "blob"))
    return mapped(both.repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "grp"), run, "grp long, blob binary, logs binary")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that aren't held out. Null texts are empty (the end alone); null ids are scored but never
    learnt from; repeated rows count and are scored as often as they come. Extra columns are ignored. With no training
    row every symbol is equally likely.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = stored(count(rows.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))), "ppm-counts")
    words, symbols = counted.filter("word is not null").drop("key"), counted.filter("word is null").select("key", "n")
    ends = F.coalesce(F.max(F.when(F.col("word") == F.lit(END_TOKEN), F.col("n"))), F.lit(0))
    total, distinct, end_n = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), ends).first()
    buckets = int(min(SIZE**2, max(BUCKETS, symbols.count() // BUCKET_ROWS)))

    def largest(df: DataFrame, limit: int) -> dict[bytes, float]:
        """log10(n + 1) of the most frequent words: those above the count that about `limit` words exceed."""
        size = df.count()
        if size > limit:
            least = df.agg(F.percentile_approx("n", 1 - limit / size, 50_000)).first()[0]
            df = df.filter(F.col("n") > least)
        table = df.select("word", "n").toArrow()
        return dict(zip(table["word"].to_pylist(), np.log10(np.asarray(table["n"], dtype=np.int64) + 1.0).tolist()))

    sent = spark.sparkContext.broadcast(largest(words.filter(F.octet_length("word").between(1, TOP_BYTES)), TOP))
    asked = stored(asking(rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), buckets), "ppm-asked")
    prices = answered(asked.filter("part = 0"), symbols, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, unknown = sent.value, float("nan")
        group, held, keys, prices = None, [], None, None
        for batch in batches:
            for first, last in alike(batch.column(0), batch.column(1)):
                grp, part, blobs, found = batch.slice(first, last - first).columns
                if grp[0].as_py() != group:
                    group, held, keys = grp[0].as_py(), [], None
                if part[0].as_py() == 0:  # prices come first
                    held += [(unpacked_keys(k), unpacked_logs(p)) for k, p in zip(blobs, found)]
                    continue
                if keys is None:
                    keys, prices = (np.concatenate(x) for x in zip(*held))
                    by_key, held = np.argsort(keys), []
                    keys, prices = keys[by_key], prices[by_key]
                for row_ids, ids, texts in map(unpacked, blobs):
                    for lo, hi, data, offsets in chunked(texts):
                        data, bounds = tokens(data, offsets)
                        row, n = bounds[2], hi - lo
                        found, inverse = distinct_words(data, bounds)
                        logs = np.fromiter((top.get(w, unknown) for w in found), np.float64, len(found))
                        known = ~np.isnan(logs)[inverse]
                        base = np.bincount(row[known], logs[inverse[known]], n)
                        seen = np.bincount(row[known], minlength=n)
                        tail, times = np.unique(row[~known] * max(len(found), 1) + inverse[~known], return_counts=True)
                        lists = pa.array(np.searchsorted(tail, np.arange(n + 1) * max(len(found), 1)).astype(np.int32))
                        rare = pa.array(found, pa.binary()).take(pa.array(tail % max(len(found), 1)))
                        symbols, sizes = canonical(data, offsets, bounds)
                        both = np.sort(symbols * ROWS + np.repeat(np.arange(n), sizes))
                        symbols, owner = both // ROWS, both % ROWS
                        runs = firsts(symbols)
                        logs = prices[np.searchsorted(keys, symbols[runs])]
                        score = np.bincount(owner, np.repeat(logs, np.diff(np.append(runs, len(symbols)))), n)
                        arrays = [row_ids.slice(lo, n), ids.slice(lo, n), pa.array(np.bincount(row, minlength=n).astype(np.int64) + 1), pa.array(seen.astype(np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))]
                        arrays += [pa.ListArray.from_arrays(lists, rare), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]
                        yield pa.record_batch(arrays, names=["_row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", "times"])

    schema = "_row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<binary>, times array<int>"
    texts = asked.filter("part = 1").select("grp", "part", "blob", F.lit(None).cast("binary").alias("logs"))
    groups = asked.select("grp").distinct().count()
    both = texts.union(prices.select("grp", F.lit(0), "blob", "logs")).repartition(max(partitions(spark), 4 * groups), "grp").sortWithinPartitions("grp", "part")
    made = stored(mapped(both, run, schema), "ppm-scores")
    tail = made.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("_row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    rest = tail.join(words, "word").groupBy("_row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = made.drop("tail", "times").join(rest, "_row", "left")
    known_end = 1 if end_n else 0
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) + float(np.log10(end_n + 1)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return out.select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
