"""Elias-Fano codes of non-decreasing sequences, with a select structure: near-minimal space, any element without decoding.

A value's lowest bits are stored packed; what is above is a unary bit string in which the i-th one stands at
(value >> width) + i. A directory counts the ones before every 512 bits (32-bit numbers, 6 % of the string), so the
i-th one is found by a binary search in the directory, a look at 64 byte counts and a table of bytes.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBxxxQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: The place of the k-th one of each byte.
_PLACE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _PLACE[_b, : _ONES[_b]] = [p for p in range(8) if _b >> p & 1]


def low_width(n: int, top: int) -> int:
    """Lowest bits to store apart for n values up to `top`."""
    return max(0, (top // n).bit_length() - 1) if n else 0


def encode(values: np.ndarray) -> bytes:
    """Code of non-decreasing unsigned 64-bit values; fewer than 2^32 of them."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n > 1 and (values[1:] < values[:-1]).any():
        raise ValueError("values must not decrease")
    top = int(values[-1]) if n else 0
    width = low_width(n, top)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(-(-(n + (top >> width)) // 512) * 64, np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    counts = _ONES[high].reshape(-1, 64).sum(axis=1, dtype=np.uint32)
    return _HEAD.pack(n, width, top) + low + high.tobytes() + (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes()


class EliasFano:
    """A code's values by place. `size` is the code's length, so that codes may stand in a row."""

    def __init__(self, code, at: int = 0):
        self.n, self.width, top = _HEAD.unpack_from(code, at)
        at += _HEAD.size
        n_low, n_high = -(-self.n * self.width // 8), -(-(self.n + (top >> self.width)) // 512) * 64
        self.low = np.concatenate([np.frombuffer(code, np.uint8, n_low, at), np.zeros(16, np.uint8)])
        self.high = np.frombuffer(code, np.uint8, n_high, at + n_low).reshape(-1, 64)
        self.before = np.frombuffer(code, "<u4", n_high // 64, at + n_low + n_high).astype(np.int64)
        self.size = _HEAD.size + n_low + n_high + n_high // 16

    def _low(self, index: np.ndarray) -> np.ndarray:
        bit = index * self.width
        window = self.low[(bit >> 3)[:, None] + np.arange(16)].view("<u8")
        shift = (bit & 7).astype(np.uint64)
        upper = np.where(shift > 0, window[:, 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((window[:, 0] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def select(self, index, block: int = 1 << 14) -> np.ndarray:
        """The values at these places, as unsigned 64-bit numbers."""
        index = np.asarray(index, np.int64)
        if len(index) and (index.min() < 0 or index.max() >= self.n):
            raise IndexError("no such element")
        out = np.zeros(len(index), np.uint64)
        for lo in range(0, len(index), block):
            own = index[lo : lo + block]
            part = np.searchsorted(self.before, own, side="right") - 1
            bytes_ = self.high[part]
            so_far = np.cumsum(_ONES[bytes_], axis=1, dtype=np.int64)
            rest = own - self.before[part]
            at = (so_far <= rest[:, None]).sum(axis=1)
            rows = np.arange(len(own))
            rest = rest - np.where(at > 0, so_far[rows, at - 1], 0)
            place = part * 512 + at * 8 + _PLACE[bytes_[rows, at], rest]
            out[lo : lo + block] = ((place - own).astype(np.uint64) << np.uint64(self.width)) | self._low(own)
        return out

    def all(self) -> np.ndarray:
        return self.select(np.arange(self.n))
