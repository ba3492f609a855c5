"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

Pieces are cut and counted in the tasks that read the texts; only lengths and check sums are
shuffled. Each group of pieces is packed on its own by vector best fit, longest pieces first: of
the open bins that can take a piece within every capacity (tokens, documents, attention cost, the
sum of squared lengths), the one whose residual vector has the smallest weighted norm afterwards.

Nulls and empty texts are one end token. Repeated rows are packed once per row. Rows with a null
id are packed like others. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featspan.llm.storage import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold: tokens, pieces, and attention cost (sum of squared lengths)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def weights(self, lengths: np.ndarray) -> np.ndarray:
        """How much each capacity counts in a bin's norm: its share of the load, 0 if it cannot bind."""
        sizes = np.array([lengths.sum(), len(lengths), (lengths.astype(float) ** 2).sum()])
        load = sizes / [self.tokens, self.documents, self.attention]
        load[1:] *= [self.documents < self.tokens, self.attention < self.tokens**2]
        return load / max(load.max(), 1e-300)


def _cut(n: int, most: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids; only the first is shorter than ``most``."""
    first = n % most or most
    return [first, *[most] * ((n - first) // most)]


def pieces(docs: DataFrame, vocabulary: str, most: int = 1024, end: int = 2, ids: bool = False, added: bool = False) -> DataFrame:
    """One row per piece of each document; with ``ids`` also the ids, as little-endian 32-bit binary.

    With ``added`` the strings of the vocabulary's added tokens are those tokens.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from featspan.llm.tokens import encoder

        encode, tail = encoder(vocabulary, added).encode, int(end).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                keys = part.column(0).to_pylist()
                for key, got in zip(keys, encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    got += tail
                    start = 0
                    for k, n in enumerate(_cut(len(got) // 4, most)):
                        own = got[4 * start : 4 * (start + n)]
                        rows.append((key, k, start, n, zlib.crc32(own), own))
                        start += n
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + ids], names=names[: 5 + ids])

    schema = PIECES + (", ids binary" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A piece over a capacity on its own gets a bin to itself."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = (capacity.weights(lengths) / full**2)[:, None]
    least = lengths.min(initial=capacity.tokens)
    left, number, opened, made = np.zeros((3, 1024)), np.zeros(1024, np.int64), 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])[:, None]
        after = left[:, :opened] - need
        fits = (after >= 0).all(axis=0)
        if fits.any():
            k = int(np.where(fits, (weight * after * after).sum(axis=0), np.inf).argmin())
            left[:, k] = after[:, k]
        else:
            if opened == left.shape[1]:
                left, number = np.hstack([left, left]), np.hstack([number, number])
            k, opened = opened, opened + 1
            left[:, k], number[k], made = full - need[:, 0], made, made + 1
        bins[i], offsets[i] = number[k], int(full[0] - left[0, k]) - lengths[i]
        if left[0, k] < least or left[1, k] < 1:  # nothing fits any more
            opened -= 1
            left[:, k], number[k] = left[:, opened], number[opened]
    return bins, offsets


def pack(cut: DataFrame, capacity: Capacity = Capacity(), group: int = 8192) -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces``; groups of about ``group`` rows are packed apart.

    ``cut`` is read twice and must be a written table. Groups are dealt by a hash of the row and of its place
    in the table, so equal rows fill several.
    """
    groups = max(1, -(-cut.count() // group))
    where = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="pack_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return cut.withColumn("pack_group", where).groupBy("pack_group").applyInPandas(place, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), added: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    cut = materialise(pieces(docs, vocabulary, capacity.tokens, added=added), "pieces")
    return pack(cut, capacity)
