"""Elias-Fano coding of non-decreasing sequences, with sampled select for random access.

Of n values up to u, each keeps its lowest ``low`` = log2(u / n) bits in a packed array; the rest
goes in unary into a bit vector, where value i sets bit (value >> low) + i. That is about
2 + log2(u / n) bits a value. Select needs the bit position of each STEP-th value only, in 32 bits.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
HEADER = struct.Struct("<QQB7x")


def encode(values: np.ndarray) -> bytes:
    """The coded form of a non-decreasing array of non-negative integers."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    upper[places] = 1
    lower = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    samples = places[::STEP].astype("<u4")
    return HEADER.pack(n, len(upper), low) + samples.tobytes() + np.packbits(lower.ravel(), bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


class Sequence:
    """A coded sequence: ``len``, ``[i]`` by select, and ``all`` values at once."""

    def __init__(self, data: bytes):
        self.n, self.bits, self.low = HEADER.unpack_from(data)
        at = HEADER.size
        self.samples = np.frombuffer(data, "<u4", -(-self.n // STEP), at)
        at += self.samples.nbytes
        size = -(-self.n * self.low // 8)
        self.lower = np.frombuffer(data, np.uint8, size, at)
        self.upper = np.frombuffer(data, np.uint8, -(-self.bits // 8), at + size)
        self.size = at + size + len(self.upper)

    def __len__(self) -> int:
        return self.n

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low:
            return np.zeros(last - first, np.uint64)
        start, stop = first * self.low, last * self.low
        bits = np.unpackbits(self.lower[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        return (bits.reshape(-1, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // STEP]), i % STEP
        byte = place // 8
        ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 64], bitorder="little"))
        ones = ones[ones >= place % 8]
        while len(ones) <= left:  # a long gap: go on in further pieces of the bit vector
            left -= len(ones)
            byte += 64
            ones = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 64], bitorder="little"))
        return ((byte * 8 + int(ones[left]) - i) << self.low) | int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, count=self.bits, bitorder="little")) if self.n else np.zeros(0, np.int64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | self._lows(0, self.n)
