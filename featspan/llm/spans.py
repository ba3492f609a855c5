"""Where words stand in an Arrow text column, and hashes of them, for any division of bytes."""

from __future__ import annotations

import numpy as np

from featspan.llm.text import U64, mixed

#: A byte table that makes A-Z equal to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_STEP = U64(0x9E3779B97F4A7C15)


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and row of each run of ``inside`` bytes; no run crosses a row's end.

    ``offsets`` are the rows' offsets into the bytes, as ``text.bytes_of`` gives them.
    """
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(np.append(inside[:-1] & (begins[1:] | ~inside[1:]), inside[-1]))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends - starts + 1, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    out = mixed((eights[starts] & _KEEP[np.minimum(lengths, 8)]) + lengths.astype(U64))
    more, done = np.flatnonzero(lengths > 8), 8
    while len(more):
        part = eights[starts[more] + done] & _KEEP[np.minimum(lengths[more] - done, 8)]
        out[more] = mixed(out[more] * _STEP + part)
        done += 8
        more = more[lengths[more] > done]
    return out
