"""Near-duplicate documents by HyperMinHash registers, banding and verification on full sets.

A document is the set of its distinct runs of five words. For each of ``registers`` hash functions
the smallest hash of the set is kept as a register of 16 bits: its number of leading zeros, and the
``MANTISSA`` bits after the first one. Equal registers in all rows of a band make two documents
candidates; the share of equal registers, corrected for those that are equal by accident, estimates
their similarity; what the estimate does not rule out is compared on the full sets.

Documents of equal sets are one class, and only its smallest document goes on. Within a bucket of
a band every document is first compared with one leader, so that a bucket costs as many pairs as
it has documents. Only buckets whose documents are then still in different components are looked
at pair by pair, in blocks of bounded size and without making a row per pair: rows are made for
pairs of different components alone, if their estimate allows a link. So no candidate is lost.

With 32 bands of 5 registers a pair at the threshold of 0.85 is missed with a chance of 7e-9, and
one at 5.5 deviations below its similarity in the estimate with about 2e-8.

Null and empty texts have no shingles and link with nothing; so do rows without an id, which are
kept. Rows that repeat an id are one document with all their links. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featspan.llm.graph import components
from featspan.llm.storage import materialise
from featspan.llm.text import U64, mixed, ngram_hashes, slices, word_hashes

MANTISSA = 10
_SKETCH = "doc_id long, n_shingles long, set_sum long, set_mix long, registers binary, bands array<long>"


def shingle_sets(column: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and how many each row has.

    A row of fewer words has its whole sequence as its one shingle.
    """
    hashes, counts = word_hashes(column, fold=True)
    starts = np.concatenate([[0], np.cumsum(counts)])
    grams = ngram_hashes(hashes, words)
    row = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
    full = np.arange(len(grams)) + words <= starts[1:][row]
    row, grams = row[full], grams[full]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        whole = np.concatenate([ngram_hashes(hashes[starts[r] : starts[r + 1]], int(counts[r])) for r in few])
        row, grams = np.concatenate([row, few]), np.concatenate([grams, whole])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.append(True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])) if len(row) else np.zeros(0, bool)
    return grams[new], np.bincount(row[new], minlength=len(counts))


def _rank_bits(least: np.ndarray) -> np.ndarray:
    """Registers of 32-bit minima: leading zeros above, then the bits after the first one."""
    zeros = 32 - np.frexp(least.astype(np.float64))[1]
    after = np.where(zeros < 32, (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & U64(0xFFFFFFFF), 0)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (after >> U64(32 - MANTISSA)).astype(np.uint16)


def hyper_registers(shingles: np.ndarray, sizes: np.ndarray, registers: int) -> np.ndarray:
    """(rows with shingles, registers) of uint16."""
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])[:-1].astype(np.int64)
    keys = (shingles >> U64(32)).astype(np.uint32)
    seeds = mixed(np.arange(1, 2 * registers + 1, dtype=U64)).astype(np.uint32)
    out = np.empty((len(starts), registers), np.uint32)
    for k in range(registers if len(starts) else 0):
        h = keys * (seeds[2 * k] | np.uint32(1))
        h += seeds[2 * k + 1]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(h, starts)
    return _rank_bits(out)


def accidental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that unequal minima of sets of these sizes fill equal registers."""
    edges = 2.0 ** -np.arange(33)
    chance = []
    for n in (a, b):
        left = (1 - edges[None, :]) ** n[:, None]  # no hash below an edge
        chance.append(np.diff(left, axis=1))  # of each number of leading zeros
    return (chance[0] * chance[1]).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of pairs of register rows."""
    equal = (a == b).mean(axis=1)
    c = accidental(size_a.astype(float), size_b.astype(float))
    return (equal - c) / (1 - c)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Set size, set digest, registers and band keys of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = mixed(np.arange(1, rows + 1, dtype=U64)) | U64(1)
        for batch in batches:
            for at, n in slices(batch, "text", 1 << 20):
                part = batch.slice(at, n)
                grams, sizes = shingle_sets(part.column(1), words)
                some = sizes > 0
                starts = np.concatenate([[0], np.cumsum(sizes[some])])[:-1].astype(np.int64)
                sums = np.zeros((2, n), U64)
                if some.any():
                    sums[0, some], sums[1, some] = np.add.reduceat(grams, starts), np.add.reduceat(mixed(grams ^ U64(0x5851F42D4C957F2D)), starts)
                regs = hyper_registers(grams, sizes, bands * rows)
                keys = (regs.reshape(-1, bands, rows).astype(U64) * step).sum(axis=2, dtype=U64)
                keys = mixed(keys + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
                filled, own, own_keys = iter(range(len(regs))), [None] * n, [[]] * n
                for r in np.flatnonzero(some).tolist():
                    k = next(filled)
                    own[r], own_keys[r] = regs[k].tobytes(), keys[k]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array(own, pa.binary()),
                        pa.array(own_keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_sum", "set_mix", "registers", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full sets of some documents, as sorted little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch, "text", 1 << 20):
                part = batch.slice(at, n)
                grams, sizes = shingle_sets(part.column(1), words)
                ends = np.cumsum(sizes)
                own = [grams[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["id", "shingles"])

    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return given.join(ids, "id", "left_semi").mapInArrow(run, "id long, shingles binary")


def _possible(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 4))
                size = [batch.column(k).to_numpy() for k in (3, 5)]
                yield batch.select([0, 1]).filter(pa.array(estimate(one, two, *size) >= least))

    a = sketch.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    b = sketch.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "na", "rb", "nb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) for the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ([np.frombuffer(x.as_buffer(), U64) for x in batch.column(k)] for k in (2, 3))
            linked = [_similar(one, two, threshold) for one, two in zip(*own, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.select([0, 1]).filter(pa.array(linked, pa.bool_())).columns, names=["u", "v"])

    a, b = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long").distinct()


def _likely(regs: np.ndarray, size: np.ndarray, label: np.ndarray, i: int, others: np.ndarray, band: int, least: float) -> np.ndarray:
    """Those of ``others`` in another component than row ``i`` that its estimate allows, if ``band`` is their first in common."""
    others = others[label[others] != label[i]]
    if len(others):
        equal = regs[others] == regs[i]
        first = equal.all(axis=2).argmax(axis=1) == band
        others, equal = others[first], equal[first]
        c = accidental(np.full(len(others), float(size[i])), size[others].astype(float))
        others = others[(equal.mean(axis=(1, 2)) - c) / (1 - c) >= least]
    return others


def _sides(group: pa.Table, same: bool) -> tuple[np.ndarray, np.ndarray]:
    side = np.asarray(group.column("side"))
    left = np.flatnonzero(side == 0)
    return left, left if same else np.flatnonzero(side == 1)


_MEMBER = "bucket long, one int, two int, side int, band int, doc_id long, component_id long, n_shingles long"


def _across(members: DataFrame, sketch: DataFrame, sets: DataFrame, threshold: int, bands: int, rows: int, least: float, block: int) -> DataFrame:
    """Edges (u, v) between different components within buckets, from full sets.

    ``members`` has bucket, band, n, volume, doc_id, component_id, registers and n_shingles. Buckets of
    more than ``block`` documents or 16 MB of sets are cut into blocks, and pairs of blocks compared
    apart. First registers alone tell which documents may have a partner; only their sets are sent. No
    pair makes a row, but for those that join two components of the task.
    """
    registers = lambda group: np.frombuffer(b"".join(group.column("registers").to_pylist()), "<u2").reshape(-1, bands, rows)

    def hopeful(key: tuple, group: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        left, right = _sides(group, same)
        label, size = (group.column(k).to_numpy() for k in ("component_id", "n_shingles"))
        regs, band = registers(group), group.column("band")[0].as_py()
        some = np.zeros(len(label), bool)
        for i in left:
            found = _likely(regs, size, label, i, right, band, least)
            some[found] = True
            some[i] |= len(found) > 0
        return group.filter(pa.array(some)).select([c.split()[0] for c in _MEMBER.split(", ")])

    def verify(key: tuple, group: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        left, right = _sides(group, same)
        ids, label, size = (group.column(k).to_numpy() for k in ("doc_id", "component_id", "n_shingles"))
        regs, band = registers(group), group.column("band")[0].as_py()
        own = [np.frombuffer(x.as_buffer(), U64) for x in group.column("shingles")]
        label, edges = label.copy(), []
        for i in left:
            for j in _likely(regs, size, label, i, right, band, least):
                if label[i] != label[j] and (not same or j > i) and _similar(own[i], own[j], threshold):
                    edges.append((ids[i], ids[j]))
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    parts = F.ceil(F.greatest(F.col("n") / block, F.col("volume") * 8 / (16 << 20))).cast("int")
    cut = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumns(
        {"one": F.least("part", "with"), "two": F.greatest("part", "with"), "side": (F.col("part") > F.col("with")).cast("int")}
    )
    keep = ["bucket", "one", "two", "side", "band", "doc_id", "component_id", "n_shingles", "registers"]
    some = materialise(cut.select(*keep).groupBy("bucket", "one", "two").applyInArrow(hopeful, _MEMBER), "hopeful")
    full = some.join(sketch.select("doc_id", "registers"), "doc_id").join(sets.withColumnRenamed("id", "doc_id"), "doc_id")
    return full.select(*keep, "shingles").groupBy("bucket", "one", "two").applyInArrow(verify, "u long, v long")


def _similar(one: np.ndarray, two: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, for sorted sets."""
    if 100 * min(len(one), len(two)) < threshold * max(len(one), len(two)):
        return False
    both = np.concatenate([one, two])
    both.sort(kind="stable")  # merges the two runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(both) - common)


def near_duplicates(
    docs: DataFrame,
    threshold: int = 85,
    words: int = 5,
    bands: int = 32,
    rows: int = 5,
    deviations: float = 5.5,
    block: int = 1024,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per document.

    Documents link if 100 * intersection >= ``threshold`` * union of their sets; a component is
    named by its smallest document, which alone is kept.
    """
    share = threshold / 100
    least = share - deviations * (share * (1 - share) / (bands * rows)) ** 0.5
    sketch = materialise(sketches(docs, words, bands, rows), "sketches")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "set_sum", "set_mix"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    copies = full.select("doc_id", *same).join(classes, same).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same])
    reps = materialise(reps, "classes")

    entries = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    order = F.xxhash64("doc_id", "bucket")
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", order).alias("leader")).where("n > 1")
    members = materialise(entries.join(buckets, "bucket"), "members")

    involved = members.select(F.col("doc_id").alias("id")).distinct()
    sets = materialise(_sets(docs, involved, words), "sets")
    stars = members.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    linked = materialise(_verified(_possible(stars, reps, least), sets, threshold), "links")

    label = components(linked).select(F.col("id").alias("doc_id"), "component_id")
    rest = members.where("n > 2 AND doc_id <> leader").join(label, "doc_id", "left")
    rest = rest.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    rest = rest.join(reps.select("doc_id", "n_shingles", "registers"), "doc_id")
    split = rest.groupBy("bucket").agg(
        F.min("component_id").alias("c0"), F.max("component_id").alias("c1"), F.sum("n_shingles").alias("volume")
    )
    rest = rest.join(split.where("c0 <> c1").select("bucket", "volume"), "bucket")
    more = _across(rest, reps, sets, threshold, bands, rows, least, block)

    final = components(copies.unionByName(linked).unionByName(more)).select(F.col("id").alias("doc_id"), "component_id")
    out = sketch.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    name = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(name == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 85) -> DataFrame:
    """The documents that are the smallest of their component, all columns.

    Rows without an id are documents too: they come after all others, in the order of a hash of their
    text, and of equal ones one stays. Rows that repeat an id stay or go together.
    What goes is a written table of ids, so that Spark knows its size: a small one is sent to the
    tasks, a large one joined by shuffle.
    """
    key = "_near_key"
    while key in docs.columns:
        key = "_" + key
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    beyond = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), beyond))
    gone = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), threshold).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    left = keyed.join(materialise(gone, "near-copies"), key, "left_anti")
    # copies among rows without an id share a key; texts without words are copies of nothing
    twice = F.col("doc_id").isNull() & text.rlike(r"[^\x20\x09-\x0D]")
    return left.where(~twice).unionByName(left.where(twice).dropDuplicates([key])).select(*docs.columns)
