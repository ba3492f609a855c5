"""Words and their hashes, computed over whole Arrow columns inside tasks.

All functions work on the UTF-8 bytes of a column without making a Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: One odd constant each for letters in a word, words in a shingle, and the finaliser.
_LETTER_STEP, _WORD_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * _MIX[0]
    x ^= x >> U64(33)
    x *= _MIX[1]
    return x ^ (x >> U64(33))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Masks that keep the first n bytes of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def powers(step: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(step), U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the row offsets into them; nulls have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary())
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(table: pa.RecordBatch | pa.Table, column: str, limit: int = 4 << 20) -> Iterator[tuple]:
    """(first row, row count) of runs of rows with about ``limit`` bytes of ``column``, one row at least."""
    if not table.num_rows:
        return
    _, offsets = bytes_of(table.column(column))
    at = 0
    while at < table.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), table.num_rows)
        yield at, end - at
        at = end


def word_hashes(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` in order, and each row's number of words.

    ``fold`` makes A-Z equal to a-z.
    """
    data, offsets = bytes_of(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, U64), counts
    ends = np.flatnonzero(np.append(inside[:-1] & (begins[1:] | ~inside[1:]), inside[-1]))
    lengths = ends - starts + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _FOLD[data] if fold else data
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    out = mixed((eights[starts] & _KEEP[np.minimum(lengths, 8)]) + lengths.astype(U64))
    more = np.flatnonzero(lengths > 8)
    done = 8
    while len(more):
        part = eights[starts[more] + done] & _KEEP[np.minimum(lengths[more] - done, 8)]
        out[more] = mixed(out[more] * U64(_LETTER_STEP) + part)
        done += 8
        more = more[lengths[more] > done]
    return out, counts


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position on; runs may cross rows, the caller masks them."""
    if len(words) < n:
        return np.zeros(0, U64)
    step = powers(_WORD_STEP, n)
    out = words[: len(words) - n + 1] * step[0]
    for k in range(1, n):
        out += words[k : len(words) - n + 1 + k] * step[k]
    return mixed(out + U64(n))
