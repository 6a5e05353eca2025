"""Hashes of all substrings of a batch of texts at once, with numpy.

A prefix sum of symbol * base^position, mod 2^64, gives the hash of any
substring by one subtraction and one multiplication with base^-start. A whole
Arrow batch is hashed as one array; where a text ends is the caller's business.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
# Texts are hashed in groups of about this many symbols; a longer text is a group of its own.
GROUP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the one base and of its inverse, for all seeds of a worker.

    A text longer than ``MOST`` gets longer tables for as long as it is worked on.
    """

    BASE = int(np.random.default_rng(1).integers(0, 1 << 61)) * 8 + 5
    MOST = 2 * GROUP

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            self.up, self.down = (self._made(factor, size) for factor in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        elif len(self.up) > self.MOST + 1 and n <= self.MOST:
            self.up, self.down = self.up[: n + 1].copy(), self.down[: n + 1].copy()

    @staticmethod
    def _made(factor: int, size: int) -> np.ndarray:
        steps = np.full(size, factor, U64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_POWERS = Powers()


class Rolling:
    """Substring hashes under one seed. Different seeds weigh the symbols independently."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | U64(1)
        self.salt = U64(int(rng.integers(1, 1 << 62)))

    def __reduce__(self):
        return shared, (self.seed,)  # a worker has one of each seed

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums of a uint8 array, or of code points as uint32."""
        n = len(symbols)
        _POWERS.reach(n)
        terms = self.table[symbols] if symbols.dtype == np.uint8 else mix(symbols.astype(U64) + self.salt) | U64(1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(terms * _POWERS.up[:n], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end); the length counts."""
        _POWERS.reach(len(sums))
        raw = (sums[end] - sums[start]) * _POWERS.down[start]
        return mix(raw + (end - start).astype(U64) * self.salt)

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` symbols from each position on (one value per position that has them)."""
        n = len(sums) - 1
        if n < width:
            return np.empty(0, U64)
        _POWERS.reach(n)
        raw = (sums[width:] - sums[: n + 1 - width]) * _POWERS.down[: n + 1 - width]
        return mix(raw + U64(width * int(self.salt) % (1 << 64)))


@lru_cache(maxsize=64)
def shared(seed: int) -> Rolling:
    return Rolling(seed)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column as one array, and the offsets of its values. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold about ``size`` symbols together."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def sliding_first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in each window of ``width`` values.

    Values are compared by their upper 40 bits; the position in the lower 24
    makes the leftmost win. The minimum of a window is that of a suffix of one
    block and a prefix of the next.
    """
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    low = U64((1 << 24) - 1)
    if n > int(low):  # a text beyond 16 MB: in overlapping pieces
        step = 1 << 23
        return np.concatenate([
            at + sliding_first_minimum(values[at : at + step + width - 1], width) for at in range(0, n - width + 1, step)
        ])
    blocks = -(-n // width)
    padded = np.full(blocks * width, TOP, U64)
    padded[:n] = (values & ~low) | np.arange(n, dtype=U64)
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
