"""Vectorised scanning of Arrow string columns into word and window hashes.

Words are maximal runs of bytes outside ``{0x20, 0x09-0x0D}``.  Those bytes are ASCII, so
the scan works on UTF-8 buffers directly and never builds a Python string per word.  A
word's hash is a polynomial over a random byte table, taken from prefix sums, then mixed;
a window's hash is a polynomial over its word hashes.  All arithmetic wraps modulo 2**64.

Nulls scan as empty texts.  A chunk holds whole documents and about ``CHUNK`` bytes, or
one document where that is longer, which bounds memory by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
ROWS = 1024  # of a chunk at most, so that a row number fits beside a 54-bit hash
U = np.uint64
_BASE, _WORD_BASE, _CHECK_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser of ``x + seed``, a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x + U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _byte_table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U), 17)
    if lower:
        table[65:91] = table[97:123]
    table[_SPACE] = 0
    return table


_TABLES = {flag: _byte_table(flag) for flag in (False, True)}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for ``i < n``; the base is odd."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, dtype=U), np.full(size, inverse, dtype=U)
        up[0] = down[0] = 1
        held = _powers[int(base)] = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
        if size > 4 * CHUNK:
            del _powers[int(base)]  # a huge document must not pin its tables
    return held[0][:n], held[1][:n]


def window_hashes(words: np.ndarray, k: int, base: np.uint64 = _WORD_BASE) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries; empty if there are fewer."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=U)
    up, down = powers(base, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(words * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


@dataclass
class Chunk:
    """Whole rows ``[lo, hi)`` of a batch; word positions are those of the chunk."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of the rows
    row_at: np.ndarray  # first byte of each row, and the end
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    hashes: np.ndarray  # of each word
    word_at: np.ndarray  # first word of each row, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def windows(self, k: int, whole: bool = False, base: np.uint64 = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each ``k``-word window inside one row, in order of position.

        With ``whole``, a row of 1 to k-1 words gives one window: its whole sequence.
        """
        counts = self.counts
        hashes = window_hashes(self.hashes, k, base)
        row_of = np.repeat(np.arange(self.hi - self.lo), counts)
        last = self.word_at[1:][row_of]
        inside = np.arange(len(row_of)) + k <= last
        rows, found = row_of[inside], hashes[inside[: len(hashes)]]
        if whole:
            short = np.flatnonzero((counts > 0) & (counts < k))
            if len(short):
                own = np.array([self.sequence_hash(r, base) for r in short], dtype=U)
                rows, found = np.concatenate([rows, short]), np.concatenate([found, own])
                order = np.argsort(rows, kind="stable")
                rows, found = rows[order], found[order]
        return rows, found

    def sequence_hash(self, row: int, base: np.uint64 = _WORD_BASE) -> int:
        words = self.hashes[self.word_at[row] : self.word_at[row + 1]]
        return mix(window_hashes(words, len(words), base), len(words))[0]


def check_base() -> np.uint64:
    """A second base: windows that agree under both bases agree in content."""
    return _CHECK_BASE


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string column, in order, every row in exactly one."""
    n = len(column)
    if not n:
        return
    offsets, data = buffers(column)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n, lo + ROWS)
        yield scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi, lower)
        lo = hi


def scan(data: np.ndarray, row_at: np.ndarray, lo: int, hi: int, lower: bool) -> Chunk:
    n = len(data)
    space = _SPACE[data]
    opens = np.empty(n + 1, dtype=bool)  # a word may begin here: after a space or at a row's start
    opens[0] = True
    opens[1:] = space
    opens[row_at] = True
    starts = np.flatnonzero(~space & opens[:n])
    ends = np.flatnonzero(~space & (opens[1:] | np.append(space[1:], True))) + 1
    up, down = powers(_BASE, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_TABLES[lower][data] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Chunk(lo, hi, data, row_at, starts, ends, hashes, np.searchsorted(starts, row_at))


def code_points(data: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Code points of each row: its bytes that do not continue a character."""
    heads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return heads[row_at[1:]] - heads[row_at[:-1]]
