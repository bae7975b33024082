"""Elias-Fano lists: n values in [0, U) that never fall, in about 2 + log2(U / n) bits each.

The low bits of each value are packed; the high bits are a unary bit vector in
which value i has the bit at (high part + i).  ``select`` finds the i-th one by
sampled positions and a short scan, so single values need no decoding.
"""

from __future__ import annotations

import struct

import numpy as np

#: Every STEP-th one of the high part has its position stored.
STEP = 256
_HEAD = struct.Struct("<QQBxxxIQ")  # n, universe, low bits, samples, bytes of the high part
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


def encode(values: np.ndarray) -> bytes:
    """The list of non-negative values, each at least the one before."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if n and (v[1:] < v[:-1]).any():
        raise ValueError("values must not fall")
    universe = int(v[-1]) + 1 if n else 0
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
    high[at] = 1
    body, high_bytes = np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    samples = at[::STEP].astype("<u8" if n and at[-1] >= 1 << 32 else "<u4")
    return _HEAD.pack(n, universe, low | (samples.itemsize == 8) << 7, len(samples), len(high_bytes)) + samples.tobytes() + body + high_bytes


class EliasFano:
    """Reads what :func:`encode` made."""

    def __init__(self, data: bytes):
        self.n, self.universe, low, samples, size = _HEAD.unpack_from(data)
        self.low = low & 0x7F
        kind = np.dtype("<u8" if low >> 7 else "<u4")
        at = _HEAD.size
        self.samples = np.frombuffer(data, kind, samples, at)
        at += samples * kind.itemsize
        body = (self.n * self.low + 7) // 8
        self.body, self.high = np.frombuffer(data, np.uint8, body, at), np.frombuffer(data, np.uint8, size, at + body)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left, bit = i % STEP, int(self.samples[i // STEP])
        byte = bit >> 3
        word = int(self.high[byte]) >> (bit & 7) << (bit & 7)  # ones from the sample on
        while True:
            ones = int(_ONES[word])
            if left < ones:
                break
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        pos = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.low):
            b = i * self.low + k
            low |= (int(self.body[b >> 3]) >> (b & 7) & 1) << k
        return (pos - i) << self.low | low

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        pos = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(self.body, bitorder="little", count=self.n * self.low).reshape(self.n, self.low).astype(np.int64)
        return (pos << self.low) + (bits << np.arange(self.low)).sum(axis=1)
