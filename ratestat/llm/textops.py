"""Vectorised text primitives shared by the operators.

Texts stay in their Arrow buffers: a batch is one byte array with document
offsets, cut into chunks of whole documents, and words, hashes and windows
are arrays of positions in it.  No Python string is made unless an operator
needs one.  A null text is an empty text.  Words are maximal runs of bytes
outside 0x20 and 0x09-0x0D, the contract's ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = np.asarray(x, dtype=_U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_CHAR_BASE = 0xD6E8FEB86659FD93
_WORD_BASE = 0xA24BAED4963EE407


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=_U)

    def _grown(self, table, base, n):
        if len(table) >= n:
            return table
        fresh = np.full(max(n, 2 * len(table)), base, dtype=_U)
        fresh[0] = 1
        return np.multiply.accumulate(fresh)

    def up(self, n):
        self._up = self._grown(self._up, self.base, n)
        return self._up

    def down(self, n):
        self._down = self._grown(self._down, self.inverse, n)
        return self._down


_CHARS, _WORDS = _Powers(_CHAR_BASE), _Powers(_WORD_BASE)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0]:off[-1]]


def doc_chunks(off: np.ndarray, raw: np.ndarray, limit: int = CHUNK_BYTES):
    """(first doc, last doc, offsets, bytes) pieces of whole documents of
    about ``limit`` bytes; one longer document is a piece of its own."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, off[a:b + 1] - off[a], raw[off[a]:off[b]]
        a = b


def word_spans(off: np.ndarray, raw: np.ndarray, between: np.ndarray = IS_SPACE):
    """(starts, ends, word offsets): byte spans of all words, and for each
    document where its words begin in them.  ``between`` marks the bytes that
    separate words."""
    if len(raw) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(off), dtype=np.int64)
    inside = ~between[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[1:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = inside[inner]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (position-independent polynomial)."""
    if len(starts) == 0:
        return np.zeros(0, dtype=_U)
    n = len(raw)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTE_CODE[raw] * _CHARS.up(n)[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * _CHARS.down(n)[starts])


def rolling_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` word hashes (runs that cross
    a document edge included; ``run_starts`` gives the valid ones)."""
    n = len(words)
    if n < width:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(words * _WORDS.up(n)[:n], out=total[1:])
    runs = total[width:] - total[:-width]
    return mix64(runs * _WORDS.down(n)[:n - width + 1])


def ragged_range(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+counts[0]-1, first[1] .. and so on, in one array."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(first, np.int64) - skip, counts)


def run_starts(word_off: np.ndarray, width: int) -> np.ndarray:
    """Positions of all runs of ``width`` words inside one document."""
    counts = np.maximum(np.diff(word_off) - width + 1, 0)
    return ragged_range(word_off[:-1], counts)


def code_points_before(raw: np.ndarray) -> np.ndarray:
    """Running count of UTF-8 code points: element i counts those that begin
    before byte i."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return hashes.view(np.int64)


def string_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string array."""
    lengths = ends - starts
    off = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=off[1:])
    data = raw[ragged_range(starts, lengths)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(data)).cast(pa.string())
