"""Many byte slices at once: which of them are alike, and their token ids, encoded once for each distinct slice and kept."""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa


def distinct_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(the distinct slices, the number of each slice among them), by their bytes; slices ascend and do not overlap."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    edges = np.empty(2 * len(start), width)
    edges[0::2], edges[1::2] = start, end
    apart = (start[1:] != end[:-1]).any()  # else they are all of the data between the first and the last
    if not apart:
        edges = np.append(edges[0::2], edges[-1])
    found = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    if apart:
        found = found.take(pa.array(np.arange(0, len(edges) - 1, 2)))  # not what stands between them
    coded = found.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def flattened(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in turn, how many each slice has) of a list of ids for each slice."""
    return np.fromiter((i for own in ids for i in own), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


class Joined:
    """Ids of many slices by a library's tokenizer, several hundred slices in one text with a special token between them.

    A tokenizer cuts texts at special tokens before anything else, so each slice is encoded as if it stood alone, without
    a call and an object of its own. Slices that hold the token's beginning are encoded alone.
    """

    TOGETHER = 512

    def __init__(self, tokenizer, special: str):
        self.tokenizer, self.special, self.id = tokenizer, special, tokenizer.token_to_id(special)

    def __call__(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lead = self.special[:2].encode()
        apart = [i for i, s in enumerate(slices) if lead in s]
        if apart:
            sizes, parts = np.zeros(len(slices), np.int64), {}
            plain = [i for i in range(len(slices)) if lead not in slices[i]]
            flat, sizes[plain] = self(list(map(slices.__getitem__, plain))) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            for i, e in zip(apart, self.tokenizer.encode_batch_fast([slices[i].decode("utf-8") for i in apart], add_special_tokens=False)):
                parts[i], sizes[i] = np.array(e.ids, np.uint32), len(e.ids)
            ends = np.cumsum(sizes)
            out = np.zeros(int(ends[-1]), np.uint32)
            mask = np.ones(len(out), bool)
            for i, own in parts.items():
                out[ends[i] - len(own) : ends[i]], mask[ends[i] - len(own) : ends[i]] = own, False
            out[mask] = flat
            return out, sizes
        joiner = self.special.encode()
        texts = [joiner.join(slices[i : i + self.TOGETHER]).decode("utf-8") + self.special for i in range(0, len(slices), self.TOGETHER)]
        made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(made)
        ends = np.flatnonzero(ids == self.id)
        return ids[ids != self.id], np.diff(ends, prepend=-1) - 1


#: The character by which byte-level BPE stands for each byte; the line feed is left to part slices.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_LEVEL = dict(zip(_SHOWN, map(chr, _SHOWN))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))} | {10: "\n"}


def one_piece(s: bytes) -> bool:
    """Whether a slice is letters or ASCII digits, with one blank before them at most: the pattern of byte-level BPE takes it whole.

    Letters from U+0500 on may be unknown to the library's tables, which can be older than Python's.
    """
    word = s[1:] if s[:1] == b" " else s
    if word.isalpha() or word.isdigit():
        return True
    if word.isascii():
        return False
    text = word.decode("utf-8")
    return text.isalpha() and max(text) < "\u0500"


class Words:
    """Ids of many slices by a byte-level BPE: those of one piece go straight to the library's model, the others to `rest`.

    The model alone takes half the time of the whole tokenizer, which searches and keeps alignments for every piece.
    """

    def __init__(self, tokenizer, rest: Callable[[list[bytes]], list | tuple[np.ndarray, np.ndarray]]):
        self.model, self.rest = tokenizer.model, rest

    @staticmethod
    def fits(tokenizer) -> bool:
        """Whether pieces are all that its model sees: byte-level, split by the pattern, nothing normalised, no added token of letters or digits."""
        split = tokenizer.pre_tokenizer
        plain = type(split).__name__ == "ByteLevel" and split.use_regex and not split.add_prefix_space and tokenizer.normalizer is None and type(tokenizer.model).__name__ == "BPE"
        return plain and tokenizer.truncation is None and tokenizer.padding is None and not any(t.content.replace(" ", "").isalnum() or not t.content.strip() for t in tokenizer.get_added_tokens_decoder().values())

    def __call__(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter(map(one_piece, slices), bool, len(slices))
        if not whole.any():
            made = self.rest(slices)
            return flattened(made) if isinstance(made, list) else made
        words = b"\n".join(compress(slices, whole)).decode("latin-1").translate(_LEVEL).split("\n")
        flat, size = flattened([[t.id for t in tokens] for tokens in map(self.model.tokenize, words)])
        if whole.all():
            return flat, size
        made = self.rest(list(compress(slices, ~whole)))
        other, sizes = flattened(made) if isinstance(made, list) else made
        total = np.zeros(len(slices), np.int64)
        total[whole], total[~whole] = size, sizes
        out, mask = np.zeros(len(flat) + len(other), np.uint32), np.repeat(whole, total)
        out[mask], out[~mask] = flat, other
        return out, total


class SliceCache:
    """Keeps the ids of distinct slices, by their bytes, in one flat array; starts anew beyond `limit` bytes of memory, about."""

    #: Bytes that a slice takes besides its own bytes and ids: object headers, its entry, its place.
    EACH = 180

    def __init__(self, encode: Callable[[list[bytes]], list | tuple[np.ndarray, np.ndarray]], limit: int = 48 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _add(self, slices: list[bytes]) -> None:
        made = self.encode(slices)
        flat, sizes = flattened(made) if isinstance(made, list) else made
        n, k = len(slices), len(self.place)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[k : k + n], self.size[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)
        self.held += sum(map(len, slices)) + 4 * len(flat) + self.EACH * n
        self.place.update(zip(slices, range(k, k + n)))

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices in turn, number of ids of each slice)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return self.ids_of(*distinct_slices(data, start, end))

    def ids_of(self, slices: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for slices given as numbers of distinct ones; there must be some."""
        if self.held > self.limit:
            self.clear()
        new = [s for s in slices if s not in self.place]
        if new:
            self._add(new)
        where = np.fromiter(map(self.place.__getitem__, slices), np.int64, len(slices))[number]
        size = self.size[where]
        ends = np.cumsum(size)
        pick = np.arange(ends[-1]) + np.repeat(self.start[where] - (ends - size), size)
        return self.flat[pick], size
