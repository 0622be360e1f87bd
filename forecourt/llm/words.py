"""Words and lines of Arrow text columns as numpy arrays, found and hashed without a Python loop.

White space is the six ASCII characters ``[\\x20\\x09-\\x0D]``; lower case touches A-Z only. Both leave the
bytes of other characters alone, so everything works on UTF-8 bytes. A hash of 64 bits stands for a word or line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 3 << 20
CHUNK_BYTES = 8 << 20  # where a slice is the unit that counts are gathered by
SLICE_ROWS = 60_000
BLOCK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (the finisher of splitmix64)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTE_VALUES = [mix(np.arange(1, 257, dtype=U64) * U64(_GOLDEN + 2 * k)) for k in range(2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.get(seed, (np.zeros(0, U64), np.zeros(0, U64)))
    if len(up) <= n:
        size = max(n, BLOCK_BYTES)
        base, inverse = _BASES[seed], pow(_BASES[seed], -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate([[U64(1)], np.full(size, b & _MASK, U64)]), dtype=U64) for b in (base, inverse))
        if size <= 2 * BLOCK_BYTES:
            _powers[seed] = (up, down)
    return up, down


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every ``data[start:end]``; spans in order and apart. Memory is bounded by a block or the longest span."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(seed, high - low)
        prefix = np.zeros(high - low + 1, U64)
        np.cumsum(_BYTE_VALUES[seed][data[low:high]] * up[: high - low], out=prefix[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(U64) * U64(_GOLDEN))
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of text (a longer text stays whole, alone)."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            j = min(j, i + SLICE_ROWS, batch.num_rows)
            yield batch.slice(i, j - i)
            i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more than rows)."""
    word = ~WHITE[data]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(word)]] = False
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a column, and the index of each row's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends), first


def unique(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of every item, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence of hashes; the order counts."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * U64(0x9FB21C651E98DF25) + h)
    return out


def line_table(column: pa.Array) -> dict[str, np.ndarray]:
    """Every line of every row: its row, two 64-bit hashes of its stripped lower-cased key, and the key's code points."""
    data, offsets = text_bytes(column)
    n = len(data)
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    # A line after a cut belongs to the row that holds the cut, also where that row's text ends there.
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], cuts, "right")])
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    ends = np.empty(len(starts), np.int64)
    last = np.ones(len(starts), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = offsets[1:][row[last]]
    ends[~last] = starts[1:][~last[:-1]] - 1
    solid = np.flatnonzero(~WHITE[data])
    low = np.searchsorted(solid, starts)
    high = np.searchsorted(solid, ends)
    full = high > low
    a, b = starts.copy(), starts.copy()
    a[full], b[full] = solid[low[full]], solid[high[full] - 1] + 1
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    lowered = LOWER[data]
    return {"row": row, "h1": hash_spans(lowered, a, b, 0), "h2": hash_spans(lowered, a, b, 1), "points": points[b] - points[a]}
