"""Counting quotient filters of packed n-grams, built and merged in sorted order.

An n-gram of word ids is a number of n * width bits. A permutation of these
numbers spreads them evenly and can be undone, so the numbers are stored whole:
the leading bits name a block, the next ones are the quotient, and the rest is
the full remainder. A filter has a bit for each quotient that occurs, a bit for
each slot that tells whether its run ends there, the remainders of the slots in
order, and a counter for each: one byte, or nine for large counts. Nothing is
lost, and two filters of a block merge by a merge of their slots.
"""

from __future__ import annotations

import struct

import numpy as np

_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HEAD = struct.Struct("<qb")
_LARGE = 255


def _mix(x: np.ndarray, turn: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    """``x`` shifted left by ``by`` bits, right if that is negative."""
    if abs(by) >= 64:
        return np.zeros_like(x)
    return x << np.uint64(by) if by >= 0 else x >> np.uint64(-by)


class Layout:
    """How n-grams of ``n`` ids of ``width`` bits are numbers, in parts of at most 64 bits each, the leading one first."""

    def __init__(self, n: int, width: int, block_bits: int = 0):
        self.n, self.width, self.bits = n, width, n * width
        count = max(2, -(-self.bits // 64))
        self.part_bits = [self.bits // count + (k < self.bits % count) for k in range(count)]
        self.masks = [np.uint64((1 << b) - 1) for b in self.part_bits]
        self.block_bits = min(block_bits, self.part_bits[0])

    def _overlaps(self):
        """(part, word, shift) for each word with bits in a part: a left shift of the word gives them."""
        low = self.bits
        for p, b in enumerate(self.part_bits):
            low -= b
            for k in range(self.n):
                at = (self.n - 1 - k) * self.width
                if at < low + b and at + self.width > low:
                    yield p, k, at - low

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Permuted numbers of the n-grams; ``words`` has their first ids, their second, and so on."""
        words = [w.astype(np.uint64) for w in words]
        parts = [np.zeros(len(words[0]), np.uint64) for _ in self.part_bits]
        for p, k, shift in self._overlaps():
            parts[p] |= _shifted(words[k], shift) & self.masks[p]
        for turn in range(3):
            for p in range(len(parts)):
                parts[p] = parts[p] ^ (_mix(parts[p - 1], turn) & self.masks[p])
        return parts

    def unpack(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The words of permuted numbers."""
        parts = list(parts)
        for turn in reversed(range(3)):
            for p in reversed(range(len(parts))):
                parts[p] = parts[p] ^ (_mix(parts[p - 1], turn) & self.masks[p])
        words = [np.zeros(len(parts[0]), np.uint64) for _ in range(self.n)]
        whole = np.uint64((1 << self.width) - 1)
        for p, k, shift in self._overlaps():
            words[k] |= _shifted(parts[p], -shift) & whole
        return words

    def block(self, parts: list[np.ndarray]) -> np.ndarray:
        return _shifted(parts[0], self.block_bits - self.part_bits[0]).astype(np.int64) if self.block_bits else np.zeros(len(parts[0]), np.int64)

    def summed(self, parts: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct numbers in order, and the sums of their counts."""
        if not len(parts[0]):
            return parts, np.zeros(0, np.int64)
        if self.bits <= 64:
            one = _shifted(parts[0], self.part_bits[1]) | parts[1]
            by = np.argsort(one, kind="stable") if counts is not None else None
            one = one[by] if by is not None else np.sort(one)
            fresh = np.r_[True, one[1:] != one[:-1]]
            kept = one[fresh]
            out = [_shifted(kept, -self.part_bits[1]), kept & self.masks[1]]
        else:
            by = np.lexsort(parts[::-1])
            parts = [p[by] for p in parts]
            fresh = np.r_[True, np.any([p[1:] != p[:-1] for p in parts], axis=0)]
            out = [p[fresh] for p in parts]
        start = np.flatnonzero(fresh)
        sums = np.diff(np.r_[start, len(fresh)]) if counts is None else np.add.reduceat(counts[by], start)
        return out, sums

    # -- filters

    def encode(self, parts: list[np.ndarray], counts: np.ndarray) -> bytes:
        """The filter of distinct sorted numbers of one block."""
        m = len(counts)
        rest = self.part_bits[0] - self.block_bits
        q = min(rest, max(0, int(m - 1).bit_length()))
        lead = parts[0] & np.uint64((1 << rest) - 1)
        quotient = _shifted(lead, q - rest).astype(np.int64) if q else np.zeros(m, np.int64)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient] = 1
        run_end = np.r_[quotient[1:] != quotient[:-1], True] if m else np.zeros(0, bool)
        bits = [(lead, rest - q), *zip(parts[1:], self.part_bits[1:], strict=True)]
        columns = [(_shifted(x, -k) & np.uint64(1)).astype(np.uint8) for x, b in bits for k in reversed(range(b))]
        remainders = np.packbits(np.stack(columns, axis=1).ravel()) if columns else np.zeros(0, np.uint8)
        large = counts > _LARGE - 1
        small = np.where(large, _LARGE, counts).astype(np.uint8)
        arrays = (np.packbits(occupied), np.packbits(run_end), remainders, small, counts[large].astype("<i8"))
        return _HEAD.pack(m, q) + b"".join(x.tobytes() for x in arrays)

    def decode(self, raw: bytes, block: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The sorted numbers of a filter and their counts."""
        m, q = _HEAD.unpack_from(raw)
        rest = self.part_bits[0] - self.block_bits
        r = self.bits - self.block_bits - q
        at = _HEAD.size

        def take(n: int, kind=np.uint8) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += got.nbytes
            return got

        occupied = np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q)
        run_end = np.unpackbits(take(-(-m // 8)), count=m).astype(np.int64)
        slots = np.unpackbits(take(-(-m * r // 8)), count=m * r).reshape(m, r)
        counts = take(m).astype(np.int64)
        large = counts == _LARGE
        counts[large] = take(int(large.sum()), "<i8")
        quotient = np.flatnonzero(occupied)[np.cumsum(run_end) - run_end].astype(np.uint64)
        parts, k = [], 0
        for b in (rest - q, *self.part_bits[1:]):
            value = np.zeros(m, np.uint64)
            for _ in range(b):
                value = value << np.uint64(1) | slots[:, k]
                k += 1
            parts.append(value)
        parts[0] |= _shifted(quotient, rest - q) | _shifted(np.full(m, block, np.uint64), rest)
        return parts, counts

    def merge(self, filters: list[bytes], block: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Sorted numbers of all filters of a block, and their counts summed."""
        decoded = [self.decode(x, block) for x in filters]
        parts = [np.concatenate(x) for x in zip(*(d[0] for d in decoded), strict=True)]
        return self.summed(parts, np.concatenate([d[1] for d in decoded]))
