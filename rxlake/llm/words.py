"""Words of UTF-8 text as 64-bit hashes, computed with numpy on Arrow buffers.

A word is a maximal run of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``
after A-Z are lower-cased: ASCII letters and digits and every byte of a
non-ASCII character.  The run never crosses a text's end.  Null and empty
texts have no words.  Buffers are walked in chunks cut between words, so a
very long text needs memory for its words only (about 24 bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_MULT = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        k = min(filled, n - filled)
        out[filled:filled + k] = out[:k] * np.uint64(pow(base, filled, 1 << 64))
        filled += k
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))[LOWER]
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, CHUNK + 4096)
        _tables["up"] = _powers(_MULT, size)
        _tables["down"] = _powers(pow(_MULT, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of len+1, bytes) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        # a null may still span bytes in the buffer: copy without them
        valid = np.asarray(column.is_valid())
        lengths = np.where(valid, np.diff(offsets), 0)
        raw = np.concatenate([raw[offsets[i]:offsets[i + 1]] for i in np.flatnonzero(lengths)] or [raw[:0]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    base = offsets[0] if len(offsets) else 0
    return (offsets - base).astype(np.int64), raw[base:base + (offsets[-1] - base)]


def word_spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, starts ascending over all texts."""
    starts, ends, hashes = [], [], []
    total = len(raw)
    text_start = np.zeros(total + 1, bool)
    text_start[offsets] = True
    at = 0
    while at < total:
        stop = min(at + CHUNK, total)
        while stop < total and IS_WORD[raw[stop - 1]] and IS_WORD[raw[stop]] and not text_start[stop]:
            tail = np.flatnonzero(~IS_WORD[raw[stop:stop + 4096]] | text_start[stop:min(stop + 4096, total)])
            stop = stop + int(tail[0]) if len(tail) else min(stop + 4096, total)
        part = raw[at:stop]
        inside = IS_WORD[part]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | text_start[at + 1:stop]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | text_start[at + 1:stop]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power_tables(len(part) + 1)
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(_VALUE[part] * up[:len(part)], out=run[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((run[e] - run[s]) * down[s]))
        at = stop
    if not starts:
        z = np.empty(0, np.int64)
        return z, z, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def word_bounds(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and the total: text i has words b[i]..b[i+1]-1."""
    return np.searchsorted(starts, offsets)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20,
                  max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about max_bytes of text (one row at least, max_rows at most)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        offsets, _ = text_buffer(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
            j = min(j, i + max_rows)
            yield batch.slice(i, j - i)
            i = j
