"""Elias-Fano code of a non-decreasing sequence, with a select directory of 32-bit block ranks."""

from __future__ import annotations

import struct

import numpy as np

#: Bits of the upper part between two entries of the select directory.
BLOCK_BITS = 512
_HEAD = struct.Struct("<QQB7x")


class EliasFano:
    """n values under ``universe``: ``low`` bits of each value packed, the rest in unary in ``high``.

    ``ranks`` holds, for each block of 512 bits of ``high``, the ones before it as an unsigned 32-bit integer, so a sequence
    has under 2**32 values. Space: n * (2 + log2(universe / n)) bits and a sixteenth of the upper part.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n >= 1 << 32:
            raise ValueError("a sequence holds under 2**32 values")
        if n and np.any(v[1:] < v[:-1]):
            raise ValueError("values must not decrease")
        top = int(v[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        if width:
            bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n, dtype=np.int64)
        size = -(-((int(at[-1]) + 1) if n else 0) // BLOCK_BITS) * BLOCK_BITS
        ones = np.zeros(size, np.uint8)
        ones[at] = 1
        return cls._ranked(n, width, low, np.packbits(ones, bitorder="little"))

    @classmethod
    def _ranked(cls, n: int, width: int, low: np.ndarray, high: np.ndarray) -> "EliasFano":
        blocks = np.bitwise_count(high).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(blocks) else np.zeros(0, "<u4")
        return cls(n, width, low, high, ranks)

    def select(self, at) -> np.ndarray:
        """The values at these places."""
        i = np.atleast_1d(np.asarray(at, dtype=np.int64))
        if len(i) == 0:
            return np.zeros(0, np.uint64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("place outside the sequence")
        block = np.searchsorted(self.ranks, i, side="right") - 1
        rows = self.high.reshape(-1, BLOCK_BITS // 8)[block]
        seen = np.cumsum(np.unpackbits(rows, axis=1, bitorder="little"), axis=1, dtype=np.int32)
        inside = np.argmax(seen == (i - self.ranks[block] + 1)[:, None], axis=1)
        upper = (block * BLOCK_BITS + inside - i).astype(np.uint64)
        return (upper << np.uint64(self.width)) | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        padded = np.concatenate([self.low, np.zeros(9, np.uint8)])
        bit = i * self.width
        got = np.zeros(len(i), np.uint64)
        for k in range(8):
            got |= padded[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        got >>= shift
        if self.width + 7 > 64:  # the last bits lie in a ninth byte
            ninth = padded[(bit >> 3) + 8].astype(np.uint64)
            got |= np.where(shift > 0, ninth << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return got & np.uint64((1 << self.width) - 1)

    def to_bytes(self) -> bytes:
        return b"".join([_HEAD.pack(self.n, len(self.high), self.width), self.low.tobytes(), self.high.tobytes(), self.ranks.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple["EliasFano", int]:
        """The sequence that begins at ``at`` and the place after it."""
        n, n_high, width = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        n_low = -(-n * width // 8)
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        blocks = n_high * 8 // BLOCK_BITS
        ranks = np.frombuffer(raw, "<u4", blocks, at + n_low + n_high)
        return cls(n, width, low, high, ranks), at + n_low + n_high + 4 * blocks
