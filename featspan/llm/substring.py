"""Removal of repeated passages, by anchors at the positions of a difference cover.

A window is ``window`` words in a row. Modulo ``PERIOD`` the cover holds, for any two positions,
offsets at which both fall on the cover: two equal windows therefore share, at the same offset, a
shorter run of words (the anchor) that starts on the cover in both documents. Only those anchors
are hashed and compared. Where an anchor is shared with another document, the windows around it
are the extensions that can match; they are compared as whole windows, by a 64-bit hash each, and
each gets the smallest document it starts in.

Documents are dealt to blocks by a hash of their id and text, so rows that repeat an id, or have none, are
spread too. A block sends every hash once, however many of
its documents hold it, as packed arrays to the bucket of the hash; the bucket answers to blocks. So
a passage that a third of all documents share costs each bucket one entry per block, and no group
of documents meets in one place. The texts are shuffled once, and read again from that shuffle.

Null and empty texts have no words. A null id is larger than any other. Rows that repeat an id do
not remove each other's words. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featspan.llm.storage import blocks_for
from featspan.llm.text import U64, ngram_hashes, slices, word_hashes

#: Every remainder modulo 7 is a difference of two of these.
PERIOD, COVER = 7, (1, 2, 4)
_PACKED = "bucket int, block int, data binary"
_NO_ID = np.iinfo(np.int64).max
_WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8")])


class _Block:
    """Word hashes of a block's documents, and the places where runs of words start."""

    def __init__(self, rows: pa.Table):
        parts = [word_hashes(rows.column("text").slice(at, n).combine_chunks()) for at, n in slices(rows, "text")]
        self.words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
        self.counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.words)) - self.starts[:-1][self.row]
        self.docs = rows.column("doc_id").fill_null(_NO_ID).to_numpy()

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``n`` words of one document start, and a hash for every position."""
        hashes = ngram_hashes(self.words, n)
        fits = self.place[: len(hashes)] + n <= self.counts[self.row[: len(hashes)]]
        return np.flatnonzero(fits), hashes

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = self.runs(length)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, hashes[at]


def _short(hashes: np.ndarray) -> np.ndarray:
    """31 bits that tell apart the hashes of one bucket; a rare tie only costs a later comparison."""
    return (hashes >> U64(33)).astype(np.uint32)


def _packets(buckets: np.ndarray, block: int, data: np.ndarray) -> pa.Table:
    """One row per bucket with its entries of ``data``."""
    order = np.argsort(buckets, kind="stable")
    buckets, data = buckets[order], data[order]
    cuts, ends = _groups(buckets)
    return pa.table(
        {
            "bucket": pa.array(buckets[cuts].astype(np.int32)),
            "block": pa.array(np.full(len(cuts), block, np.int32)),
            "data": pa.array([data[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        }
    )


def _entries(packets: pa.Table, kind: np.dtype, by: str) -> tuple[np.ndarray, np.ndarray]:
    """All entries of some packets, and for each the value of column ``by`` of its packet."""
    parts = [np.frombuffer(d, kind) for d in packets.column("data").to_pylist()]
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(packets.column(by).to_numpy(), [len(p) for p in parts])


def repeated_passages(docs: DataFrame, window: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document doc_id, n_words, n_removed, and text: the kept words, joined by one space.

    A word goes if a window over it also starts in a document with a smaller id.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    anchor = window - PERIOD + 1
    blocks = blocks_for(docs, "text", block_bytes)
    # a packet goes from each block to each bucket: fewer buckets than blocks keep packets from getting tiny
    buckets = min(blocks, max(64, blocks // 8))
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    in_blocks = given.groupBy("block")

    def announce(key: tuple, rows: pa.Table) -> pa.Table:
        block = _Block(rows)
        at, hashes = block.anchors(anchor)
        order = np.argsort(hashes, kind="stable")
        hashes, row = hashes[order], block.row[at[order]]
        first, end = _groups(hashes)
        several = row[first] != row[end - 1]  # rows rise within equal hashes, as the sort is stable
        own = hashes[first]
        return _packets(own % U64(buckets), key[0].as_py(), _short(own) << np.uint32(1) | several.astype(np.uint32))

    def compare(key: tuple, packets: pa.Table) -> pa.Table:
        data, block = _entries(packets, np.dtype("<u4"), "block")
        short, several = data >> np.uint32(1), data & np.uint32(1)
        order = np.argsort(short, kind="stable")
        short, several, block = short[order], several[order], block[order]
        first, end = _groups(short)
        shared = (end - first > 1) | (np.maximum.reduceat(several, first) > 0)
        own = np.repeat(shared, end - first)
        return _answers(key[0].as_py(), block[own], short[own])

    def extend(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(rows)
        short, bucket = _entries(answers, np.dtype("<u4"), "bucket")
        shared = np.sort(bucket.astype(np.uint64) << U64(31) | short)
        at, hashes = block.anchors(anchor)
        at = at[_among((hashes % U64(buckets)) << U64(31) | _short(hashes), shared)]
        # a window can match if one of the anchors that start in its first PERIOD words is shared
        count = np.zeros(len(block.words) + PERIOD + 1, np.int32)
        count[at + 1] = 1
        count = np.cumsum(count)
        starts, hashes = block.runs(window)
        starts = starts[count[starts + PERIOD] > count[starts]]
        own = np.empty(len(starts), _WINDOW)
        own["hash"], own["doc"] = hashes[starts], block.docs[block.row[starts]]
        own = _smallest(own)
        return _packets(own["hash"] % U64(buckets), key[0].as_py(), own)

    def earliest(key: tuple, packets: pa.Table) -> pa.Table:
        data, block = _entries(packets, _WINDOW, "block")
        least = _smallest(data)
        before = least["doc"][np.searchsorted(least["hash"], data["hash"])]
        later = before < data["doc"]
        out = data[later]
        out["doc"] = before[later]
        return _answers(key[0].as_py(), block[later], out)

    def remove(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(rows)
        starts, hashes = block.runs(window)
        own = np.empty(len(starts), _WINDOW)
        own["hash"], own["doc"] = hashes[starts], block.docs[block.row[starts]]
        least = _smallest(np.concatenate([own, _entries(answers, _WINDOW, "bucket")[0]]))
        gone = starts[least["doc"][np.searchsorted(least["hash"], own["hash"])] < own["doc"]] if len(own) else starts
        edges = np.zeros(len(block.words) + 1, np.int32)
        edges[gone] += 1
        np.subtract.at(edges, gone + window, 1)
        removed = np.cumsum(edges[:-1]) > 0
        n_removed = np.add.reduceat(np.append(removed, False), block.starts[:-1]) * (block.counts > 0) if len(block.counts) else block.counts
        kept = []
        for k, text in enumerate(rows.column("text").cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            if n_removed[k]:
                words = [w for w, r in zip(words, removed[block.starts[k] : block.starts[k + 1]].tolist(), strict=True) if not r]
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(block.counts, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    shared = in_blocks.applyInArrow(announce, _PACKED).groupBy("bucket").applyInArrow(compare, _PACKED)
    windows = in_blocks.cogroup(shared.groupBy("block")).applyInArrow(extend, _PACKED)
    earlier = windows.groupBy("bucket").applyInArrow(earliest, _PACKED)
    return in_blocks.cogroup(earlier.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, text string")


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    edges = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return (np.append(0, edges), np.append(edges, len(ordered))) if len(ordered) else (edges, edges)


def _answers(bucket: int, blocks: np.ndarray, data: np.ndarray) -> pa.Table:
    """Packets of one bucket's answers, one per block."""
    out = _packets(blocks, bucket, data)
    return pa.table({"bucket": out.column("block"), "block": out.column("bucket"), "data": out.column("data")})


def _smallest(windows: np.ndarray) -> np.ndarray:
    """One entry per hash, with its smallest document, by hash."""
    windows = windows[np.lexsort((windows["doc"], windows["hash"]))]
    return windows[_groups(windows["hash"])[0]]


def _among(keys: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted members."""
    if not len(members):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(members, keys), len(members) - 1)
    return members[at] == keys
