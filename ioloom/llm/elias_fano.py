"""Elias-Fano coding of a non-decreasing sequence: about 2 + log2(last / count) bits a value."""

from __future__ import annotations

import numpy as np

#: Every how many values the place of a value's bit in the high part is recorded.
SAMPLE = 256


class EliasFano:
    """Values v_0 <= v_1 <= ...: the low bits side by side, the high bits in unary with select samples."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Values first to first + count - 1, found from the nearest sample before them."""
        if count <= 0:
            return np.zeros(0, np.uint64)
        samples = np.frombuffer(self.samples, "<u4")
        begin = int(samples[first // SAMPLE]) // 8
        after = -(-(first + count) // SAMPLE)
        end = int(samples[after]) // 8 + 1 if after < len(samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin, begin), bitorder="little")) + 8 * begin
        ones = ones[ones >= samples[first // SAMPLE]][first % SAMPLE :][:count]
        upper = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return upper
        bit = first * self.low_bits
        raw = np.unpackbits(np.frombuffer(self.low, np.uint8)[bit // 8 : -(-(bit + count * self.low_bits) // 8)], bitorder="little")
        bits = raw[bit % 8 :][: count * self.low_bits].reshape(count, self.low_bits).astype(np.uint64)
        return upper | (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
