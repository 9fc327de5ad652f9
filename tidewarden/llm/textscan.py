"""Vectorised scanning of UTF-8 text columns inside Arrow tasks.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
lower-casing A-Z. A word is identified by a 64-bit polynomial hash of its bytes
(random byte values, odd base, final mixing), computed for all words of a chunk
at once from one cumulative sum. With ten million distinct words the chance
that any two share a hash is below 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass looks at; temporaries are about 40 times this.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes.

    Yields ``(first_row, end_row, bytes, offsets)``; a null is an empty text
    and a text longer than ``limit`` comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start bytes, lengths of all words, and the words of each row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[data]
    space = _SPACE[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:]))
    up, down = _power_tables(n)
    sums = np.cumsum(_BYTE_VALUE[low] * up[:n], dtype=np.uint64)
    head = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mix((sums[ends] - head) * down[starts])
    per_row = np.diff(np.searchsorted(starts, offsets))
    return hashes, starts, ends - starts + 1, per_row


def rows_of(per_row: np.ndarray) -> np.ndarray:
    """The row number of each item when row i has ``per_row[i]`` items."""
    return np.repeat(np.arange(len(per_row)), per_row)


def utf8_row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One text as ``words`` wants it."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])
