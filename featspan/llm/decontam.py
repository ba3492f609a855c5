"""Benchmark decontamination by suffix arrays over the training text.

Every batch of documents in a task is one shard. Its words become numbers of the benchmark's
vocabulary (0 for any other word), and the positions from which a window's worth of benchmark words
runs on are sorted by the words that follow: the shard's suffix array. No other suffix can hold a
match. Every suffix of every benchmark item is searched in it by bisection, which gives every place
where the item's window at that suffix occurs; those whose window has no hash in common with the
shard cannot occur and are told by one merge of sorted hashes, so a shard's cost hardly grows with the
benchmark. Places that follow one another in both texts make up
longer verbatim matches. Hit words, items and contamination follow from those places. Suffixes are
positions, never copies: memory grows with the words of a shard and of a block, not with their square.

The benchmark is the query set. Tasks cut its items into pieces and write them as a table, in blocks
of about ``block_words`` words. Items longer than that are cut into pieces that overlap by the longest
document, so that no match is lost or shortened. One block at a time is read by the driver, sent to
the tasks and held against all documents; its hits are written before the next one is read.

Null texts have no words; benchmark rows with a null id are left out and equal items count once
per id. Repeated documents are judged each on its own. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featspan.llm.storage import materialise, new_folder
from featspan.llm.text import U64, mixed, ngram_hashes

#: ASCII bytes outside words become spaces, A-Z become a-z; all other bytes are parts of words.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class TestIndex:
    """A block of benchmark pieces: their vocabulary, and each piece as one array of its words' numbers."""

    __test__ = False

    def __init__(self, pieces: list[tuple[str, list[bytes], int]], window: int):
        """``pieces`` are item, words, and the words of the item's window."""
        self.ids: dict[bytes, int] = {}
        self.window, self.longest = window, 1
        self.pieces: list[tuple[str, bytes, int]] = []
        self.least = min((size for _, _, size in pieces), default=window)
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, words, size in pieces:
            numbers = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], ">u4")
            self.longest = max(self.longest, len(words))
            windows.setdefault(size, []).append((_window_hashes(numbers, size), len(self.pieces)))
            self.pieces.append((item, numbers.tobytes(), size))
        #: per size of window the sorted hashes of all test suffixes' windows, and the piece and place of each
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, own in windows.items():
            hashes = np.concatenate([h for h, _ in own])
            piece = np.repeat(np.array([i for _, i in own], np.int32), [len(h) for h, _ in own])
            at = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in own])
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = hashes[order], piece[order], at[order]

    def suffixes(self, numbers: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The suffix array of a shard's suffixes that can match: the first window of each, its position, its known words.

        ``numbers`` are the words of all documents, ``ends`` for each word where its document ends.
        """
        stops = np.flatnonzero(numbers == 0)
        here = np.arange(len(numbers))
        run = np.minimum(np.append(stops, len(numbers))[np.searchsorted(stops, here)], ends) - here
        at = np.flatnonzero(run >= self.least)
        order = at[_sorted(numbers, run, at, self.longest)]
        raw = numbers.astype(">u4").tobytes()
        heads = [raw[4 * i : 4 * (i + n)] for i, n in zip(order.tolist(), np.minimum(run[order], self.window).tolist(), strict=True)]
        return heads, order, run[order]

    def present(self, numbers: np.ndarray, order: np.ndarray, run: np.ndarray) -> dict[int, list[int]]:
        """By piece the places of the test suffixes whose window has the hash of one in the shard; no other can match."""
        out: dict[int, list[int]] = {}
        for size, (hashes, piece, at) in self.by_size.items():
            places = order[run >= size]
            if not len(places):
                continue
            own = np.unique(_window_hashes(numbers, size)[places])
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for i, k in zip(piece[a:b].tolist(), at[a:b].tolist(), strict=True):
                    out.setdefault(i, []).append(k)
        return out

    def search(self, numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(item, words in a window, positions of that window, words matched up to its end) per matching test suffix."""
        own, order, run = self.suffixes(numbers, ends)
        if not own:
            return
        before = np.zeros(len(numbers) + 1, np.int32)  # at a position: words matched by the suffix before it, at the position before
        for i, found in sorted(self.present(numbers, order, run).items()):
            item, words, size = self.pieces[i]
            last, place = order[:0], -2
            for at in sorted(found):
                if at != place + 1:
                    before[last + 1] = 0
                    last = order[:0]
                need = words[4 * at : 4 * (at + size)]
                low = bisect_left(own, need)
                high = bisect_left(own, need + b"\xff" * 4, low) if low < len(own) and own[low].startswith(need) else low
                places = order[low:high]
                if len(places):
                    reached = np.where((before[places] > 0) & (ends[places - 1] == ends[places]), before[places] + 1, size)
                    before[last + 1] = 0
                    before[places + 1] = reached
                    yield item, size, places, reached
                else:
                    before[last + 1] = 0
                last, place = places, at
            before[last + 1] = 0


def _window_hashes(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each position on."""
    return ngram_hashes(mixed(numbers.astype(U64)), size)


def _sorted(numbers: np.ndarray, run: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes at ``at`` by the words up to the end of their run, ``most`` words deep; ranks by doubling."""
    # all positions of the runs that hold such suffixes; those of one run lie side by side in ``inside``
    inside = np.flatnonzero((run > 0) & np.isin(np.arange(len(run)) + run, at + run[at]))
    left, rank = run[inside], numbers[inside].astype(np.int64)
    depth, deepest = 1, min(most, int(left.max(initial=0)))
    while depth < deepest:
        following = np.zeros(len(inside), np.int64)
        more = np.flatnonzero(left > depth)
        following[more] = rank[more + depth]
        kinds, rank = np.unique(rank * (int(rank.max()) + 1) + following, return_inverse=True)
        rank, depth = rank + 1, 2 * depth
        if len(kinds) == len(rank):
            break
    return np.argsort(rank[np.searchsorted(inside, at)], kind="stable")


def _cut(benchmark: DataFrame, docs: DataFrame, window: int, block_words: int) -> DataFrame:
    """item, words of its window, number of words and text of each piece; as a written table.

    Only items that could be longer than a block are cut. Their pieces overlap by as many words as the
    longest document can have, so that every match lies whole in one of them.
    """
    given = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    step, overlap = max(block_words, window), 0

    def most_words(df: DataFrame) -> int:
        return ((df.agg(F.max(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) + 1) // 2

    if most_words(given) > step:
        overlap = max(window, most_words(docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                size = min(window, len(words))
                for at in range(0, len(words) - size + 1, step) if words else ():
                    own = words[at : at + step + overlap] if overlap else words
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()]), pa.array([size], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([b" ".join(own)], pa.binary())],
                        names=["item", "size", "n", "words"],
                    )

    return materialise(given.distinct().mapInArrow(cut, "item string, size int, n long, words binary"), "benchmark-pieces")


def _blocks(pieces: DataFrame, block_words: int) -> list[DataFrame]:
    """Pieces in blocks of about ``block_words`` words, dealt by a hash; at least one."""
    spark = pieces.sparkSession
    n = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    if n == 1:
        return [pieces]
    path = new_folder(spark, "benchmark-blocks")
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    return [written.where(F.col("block") == r["block"]) for r in written.select("block").distinct().collect()]


def _index(block: DataFrame, window: int) -> TestIndex:
    rows = block.select("item", "words", "size").collect()
    return TestIndex([(r["item"], bytes(r["words"]).split(b" "), r["size"]) for r in rows], window)


_FOUND = "doc_id {kind}, text_hash long, n_words long, covered array<int>, items array<string>, longest int"


def _match(docs: DataFrame, block: Callable[[], TestIndex]) -> DataFrame:
    """Per document its words, the covered runs [start, end, ...] in words, matching items, longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block()
        number = index.ids.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [words_of(t) for t in part.column(2).to_pylist()]
                counts = np.array([len(w) for w in words], np.int64)
                starts = np.concatenate([[0], np.cumsum(counts)])
                numbers = np.fromiter((number(w, 0) for own in words for w in own), np.uint32, int(starts[-1]))
                items: list[set[str]] = [set() for _ in words]
                longest = np.zeros(len(words), np.int32)
                edges = np.zeros(len(numbers) + 1, np.int32)
                for item, size, places, reached in index.search(numbers, np.repeat(starts[1:], counts)):
                    edges[places] += 1
                    edges[places + size] -= 1
                    rows = np.searchsorted(starts, places, "right") - 1
                    np.maximum.at(longest, rows, reached)
                    for row in set(rows.tolist()):
                        items[row].add(item)
                inside = np.append(np.cumsum(edges[:-1]) > 0, False)
                covered = []
                for row in range(len(words)):
                    if not items[row]:
                        covered.append([])
                        continue
                    own = np.concatenate([[False], inside[starts[row] : starts[row + 1]], [False]])
                    covered.append(np.flatnonzero(own[1:] != own[:-1]).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(covered, pa.list_(pa.int32())), pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(longest)],
                    names=["doc_id", "text_hash", "n_words", "covered", "items", "longest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, _FOUND.format(kind=kind))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, covered runs of words, matching item ids, longest match in words.

    With more than one block of benchmark items each document's runs and items are united; the blocks
    are searched one after the other, and only documents with hits are written for all but the first.
    """
    spark = docs.sparkSession
    first, *others = _blocks(_cut(benchmark, docs, window, block_words), block_words)
    if not others:
        index = _index(first, window)
        return _match(docs, lambda: index)
    out = None
    for block in (first, *others):
        sent = spark.sparkContext.broadcast(_index(block, window))
        found = _match(docs, lambda sent=sent: sent.value).withColumn("_row", F.lit(int(out is None)))
        found = materialise(found if out is None else found.where(F.size("items") > 0), "hits")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    # rows that agree in id and text are united, and as many given back as there were
    one = out.groupBy("doc_id", "text_hash", "n_words").agg(
        F.flatten(F.collect_list("covered")).alias("covered"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
        F.sum("_row").cast("int").alias("_copies"),
    )
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """Contamination per document: hit words, items, and whether 1/``share`` of the words are hit."""
    found = matches(docs, benchmark, window, block_words)
    numbers = F.when(F.size("covered") > 0, F.sequence(F.lit(0), (F.size("covered") / 2 - 1).cast("int")))
    runs = F.transform(numbers, lambda i: F.struct(F.get("covered", 2 * i).alias("a"), F.get("covered", 2 * i + 1).alias("b")))
    # runs of several blocks can overlap: sum what each adds beyond the end reached so far
    hit = F.aggregate(
        F.array_sort(F.coalesce(runs, F.array().cast("array<struct<a:int,b:int>>"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")
        ),
        lambda s: s["n"].cast("long"),
    )
    return found.withColumn("n_hit", hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("longest").cast("long").alias("longest_match"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents without contaminated ones, all columns; every row is judged by its own text, with an id or without.

    The hashes of the texts that go are a written table, so that Spark knows its size: a small one is
    sent to the tasks, a large one joined by shuffle.
    """
    key = "_text_key"
    while key in docs.columns:
        key = "_" + key
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    judged = judge(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, window, share)
    bad = materialise(judged.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def digest(items: list[str]) -> str:
    """The digest of item ids that ``judge`` reports, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
