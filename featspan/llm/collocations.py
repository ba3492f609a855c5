"""Collocations by dynamic itemset counting: phrase lengths interleave in cyclic scans of shards.

The documents are dealt to ``shards`` shards by a hash of the row. Round after round scans the next
shard, and after the last one the first again. Single words are counted from round 0 on. A longer
phrase is activated as soon as both its subphrases (all but its last and all but its first word)
have reached the threshold in what has been counted so far, and is then counted for one full cycle
of shards, whatever round that begins in. So one scan counts words, pairs and longer phrases at
once, and rounds end when no phrase was activated for a whole cycle.

Tasks see which phrases have reached the threshold, and in which round, from a table of ``slots``
bytes: the round in which a phrase of that hash first did so. Its size does not grow with the data.
Two phrases may share slots; then one of them is activated too early and counted for nothing, but a
phrase's cycle stays the same in all tasks and rounds, so counts are exact. Phrases that no other
hash hides are never counted unless both subphrases can be frequent.

Counts are combined over a few megabytes of text before they leave a task, so a phrase that most
documents share costs a row per slice. Phrases in the middle of their cycle are kept in a table
bucketed by phrase, to which the next round's counts are shuffled; those that end below the
threshold are dropped with it. Texts and partial counts of the frequent phrases are put together
length by length at the end. Words and phrases are told apart by 64-bit hashes.

Null texts have no words, a null language is ``und``; repeated rows count each on their own, and an
empty table has no phrases. A document is read in one task.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featspan.llm.spans import FOLD, span_hashes, word_spans
from featspan.llm.storage import materialise, new_folder, shuffle_width
from featspan.llm.text import U64, bytes_of, mixed, slices
from featspan.session import drop_table

#: What divides a text into pieces, and a piece into words.
CUTS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_CUT, _WORD = np.zeros(256, bool), np.ones(256, bool)
_CUT[list(CUTS)] = True
_WORD[list(CUTS + BLANKS)] = False
_NEVER, _MOST_ROUNDS = 255, 250
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: ``hp`` and ``hs`` are the hashes of all but the last and all but the first word; a word has its own
#: hash and 0, the number of all words of a language (n = 0) that of the language and -1.
_COUNTS = "n int, start int, hp long, hs long, lang string, word string, f long"


def joined(prefix: np.ndarray, suffix: np.ndarray, n: int) -> np.ndarray:
    """The hash of a phrase of ``n`` words from those of its two subphrases."""
    return mixed(prefix * _LEFT + suffix * _RIGHT + U64(n))


def _seed(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Slots:
    """The round in which a phrase with this hash first reached the threshold; two places a hash."""

    def __init__(self, size: int):
        self.size = size
        self.rounds = np.full(size, _NEVER, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (hashes % U64(size)).astype(np.int64), ((hashes >> U64(32)) % U64(size)).astype(np.int64)

    @staticmethod
    def reached(rounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        one, other = Slots.places(hashes, len(rounds))
        return np.maximum(rounds[one], rounds[other])

    def mark(self, new: DataFrame, now: int) -> bool:
        """Enter the phrases of ``new`` (n, hp, hs); whether there were any.

        The tasks turn them into bitmaps of 32,768 places each, so the driver receives ``size`` bits at most.
        """
        size = self.size

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.concatenate([*Slots.places(_own_hash(batch), size)]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found))], ["place"])

        bits = new.select("n", "hp", "hs").mapInArrow(places, "place long")
        bits = bits.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        some = False
        for row in bits.collect():
            some, at = True, (row.b - 1) * 32768
            on = np.flatnonzero(np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")) + at
            self.rounds[on] = np.minimum(self.rounds[on], now)
        return some


def _own_hash(batch: pa.RecordBatch) -> np.ndarray:
    n, hp, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "hp", "hs"))
    hp, hs = hp.astype(np.int64).view(U64), hs.astype(np.int64).view(U64)
    return np.where(n == 1, hp, mixed(hp * _LEFT + hs * _RIGHT + n.astype(U64)))


class _Text:
    """The words of a slice of documents: where they stand, their hashes, and the piece each is in."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = bytes_of(part.column("text"))
        self.data = FOLD[data]
        self.starts, self.lengths, rows = word_spans(_WORD[data], offsets)
        self.piece = np.cumsum(_CUT[data], dtype=np.int64)[self.starts] + rows if len(data) else rows
        langs = part.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[rows]
        self.seeds = np.array([_seed(x) for x in self.langs], U64)
        self.hashes = mixed(span_hashes(self.data, self.starts, self.lengths) ^ self.seeds[self.lang]) if len(rows) else np.zeros(0, U64)

    def words(self) -> Iterator[pa.RecordBatch]:
        """A row per word of a language, and one per language for all its words."""
        if not len(self.hashes):
            return
        kinds, at, f = np.unique(self.hashes, return_index=True, return_counts=True)
        raw = self.data.tobytes()
        text = [raw[s : s + n].decode("utf-8", "replace") for s, n in zip(self.starts[at].tolist(), self.lengths[at].tolist(), strict=True)]
        yield _rows(1, np.zeros(len(kinds), np.int32), kinds, np.zeros(len(kinds), U64), f, [self.langs[i] for i in self.lang[at]], text)
        all_words = np.bincount(self.lang, minlength=len(self.langs))
        yield _rows(0, np.zeros(len(all_words), np.int32), self.seeds, np.full(len(all_words), 2**64 - 1, U64), all_words, self.langs, [""] * len(all_words))

    def phrases(self, rounds: np.ndarray, now: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
        """A row per phrase in its cycle: activated in the last ``shards`` rounds."""
        hashes, reached = self.hashes, Slots.reached(rounds, self.hashes)
        for n in range(2, longest + 1):
            if len(hashes) < 2:
                return
            both = (reached[:-1] != _NEVER) & (reached[1:] != _NEVER) & (self.piece[: len(hashes) - 1] == self.piece[n - 1 :])
            at = np.flatnonzero(both)
            if not len(at):
                return
            start = np.maximum(reached[at], reached[at + 1]).astype(np.int32) + 1
            whole = joined(hashes[at], hashes[at + 1], n)
            due = np.flatnonzero(start > now - shards)
            if len(due):
                _, first, f = np.unique(whole[due], return_index=True, return_counts=True)
                first = due[first]
                yield _rows(n, start[first], hashes[at[first]], hashes[at[first] + 1], f)
            longer, when = np.zeros(len(hashes) - 1, U64), np.full(len(hashes) - 1, _NEVER, np.uint8)
            longer[at], when[at] = whole, Slots.reached(rounds, whole)
            hashes, reached = longer, when


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so that neither side holds much of them at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rows(n, start, hp, hs, f, lang=None, word=None) -> pa.RecordBatch:
    none = pa.nulls(len(f), pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(f), n, np.int32)),
            pa.array(start),
            pa.array(hp.view(np.int64)),
            pa.array(hs.view(np.int64)),
            none if lang is None else pa.array(lang, pa.string()),
            none if word is None else pa.array(word, pa.string()),
            pa.array(f.astype(np.int64)),
        ],
        names=["n", "start", "hp", "hs", "lang", "word", "f"],
    )


def _scan(docs: DataFrame, known: Broadcast, now: int, shards: int, longest: int, slice_bytes: int) -> DataFrame:
    """What round ``now`` counts in its shard, dealt by phrase as the state is."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = np.frombuffer(zlib.decompress(known.value), np.uint8)
        for batch in batches:
            for at, rows in slices(batch, "text", slice_bytes):
                text = _Text(batch.slice(at, rows))
                if now < shards:
                    yield from _in_parts(text.words())
                if now:
                    yield from _in_parts(text.phrases(rounds, now, shards, longest))

    own = docs.where(F.col("shard") == now % shards).select("text", "lang")
    dealt = own.mapInArrow(count, _COUNTS).repartition(shuffle_width(spark), "hp", "hs")
    return dealt.groupBy("hp", "hs", "n", "start", "lang", "word").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = 2, slots: int = 1 << 24, slice_bytes: int = 4 << 20) -> DataFrame:
    """n, id, hp, hs, lang, word, f of every phrase of up to ``longest`` words with ``f >= least`` in its language.

    Also a row with n = 0 per language, whose f is the number of its words. lang and word are null
    for longer phrases, which name their subphrases by ``hp`` and ``hs``. The result is a written table.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int"))
    table, done, state = Slots(slots), [], None
    last = -1
    for now in range(_MOST_ROUNDS):
        known = spark.sparkContext.broadcast(zlib.compress(table.rounds.tobytes(), 1))
        counts = _scan(docs, known, now, shards, longest, slice_bytes)
        if state is not None:
            before = spark.table(state).where(F.col("start") > now - shards).withColumnsRenamed({c: f"{c}_" for c in ("n", "start", "lang", "word", "f")})
            both = counts.join(before.drop("before"), ["hp", "hs"], "full_outer")
            counts = both.select(
                "hp", "hs", *[F.coalesce(c, f"{c}_").alias(c) for c in ("n", "start", "lang", "word")],
                (F.coalesce("f", F.lit(0)) + F.coalesce("f_", F.lit(0))).alias("f"), F.coalesce("f_", F.lit(0)).alias("before"),
            )
        else:
            counts = counts.withColumn("before", F.lit(0).cast("long"))
        # a phrase that has ended its cycle below the threshold is left out for good
        counts = counts.where((F.col("start") > now + 1 - shards) | (F.col("f") >= least) | (F.col("n") == 0))
        following = f"featspan_phrases_{uuid.uuid4().hex}"
        counts.write.bucketBy(width, "hp", "hs").option("path", new_folder(spark, "phrases")).saveAsTable(following)
        known.destroy()
        ended = spark.table(following).where((F.col("start") == now + 1 - shards) & ((F.col("f") >= least) | (F.col("n") == 0)))
        done.append(materialise(_with_id(ended), "phrases-done"))
        if state is not None:
            drop_table(spark, state)
        state = following
        new = spark.table(state).where((F.col("f") >= least) & (F.col("before") < least) & F.col("n").between(1, longest - 1))
        if table.mark(new, now):
            last = now
        if now >= last + shards:
            break
    else:
        raise RuntimeError(f"phrases were still activated after {_MOST_ROUNDS} rounds")
    drop_table(spark, state)
    return reduce(DataFrame.unionByName, done)


def _with_id(phrases: DataFrame) -> DataFrame:
    columns = ["n", "hp", "hs", "lang", "word", "f"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("id", pa.array(_own_hash(batch).view(np.int64)))

    return phrases.select(*columns).mapInArrow(add, "n int, hp long, hs long, lang string, word string, f long, id long")


def _spelled(frequent: DataFrame, longest: int) -> DataFrame:
    """Phrases of 2 words and more with their texts, and how often their first and last k words occur for each k."""
    words = frequent.where("n = 1").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    level = materialise(words.withColumns({"lefts": F.array("f"), "rights": F.array("f")}), "phrases-1")
    out = []
    for n in range(2, longest + 1):
        prefix = level.select(F.col("id").alias("hp"), "lang", F.col("phrase").alias("head"), "lefts")
        suffix = level.select(F.col("id").alias("hs"), "last", "rights")
        found = frequent.where(F.col("n") == n).select("n", "id", "hp", "hs", "f").join(prefix, "hp").join(suffix, "hs")
        level = materialise(
            found.select(
                "n", "id", "hp", "hs", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f",
                F.concat("lefts", F.array("f")).alias("lefts"), F.concat("rights", F.array("f")).alias("rights"),
            ),
            f"phrases-{n}",
        )
        out.append(level)
    return reduce(DataFrame.unionByName, out)


#: 1000 a n / (l r) in whole numbers of up to 38 digits; the lowest cut, ties to the smallest k.
_WORST_CUT = """array_min(transform(sequence(1, n - 1), k -> struct(
    (cast(1000 * a as decimal(18, 0)) * cast(words as decimal(19, 0))) div (cast(lefts[k - 1] as decimal(18, 0)) * cast(rights[n - k - 1] as decimal(19, 0))) as score,
    k, lefts[k - 1] as l, rights[n - k - 1] as r)))"""


def score_cuts(phrases: DataFrame) -> DataFrame:
    """Add l, r and score of the lowest-scoring cut to n, a, words (of the language), lefts, rights."""
    return phrases.withColumn("cut", F.expr(_WORST_CUT)).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000, **counting) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    A phrase is left out if a longer frequent one around it occurs at least ``covered`` percent as often.
    It is enough to look at those one word longer: what lies between two phrases occurs no less often
    than the longer one. ``counting`` goes to ``frequent_phrases``.
    """
    width = shuffle_width(docs.sparkSession)
    frequent = frequent_phrases(docs, least, longest, **counting)
    phrases = _spelled(frequent, longest)
    longer = phrases.where("n > 2")
    around = longer.select(F.col("hp").alias("id"), "f").unionByName(longer.select(F.col("hs").alias("id"), "f"))
    around = around.groupBy("id").agg(F.max("f").alias("most"))
    kept = phrases.join(around, "id", "left").where(F.coalesce(100 * F.col("most") < covered * F.col("f"), F.lit(True)))
    totals = frequent.where("n = 0").groupBy("lang").agg(F.sum("f").alias("words"))
    scored = score_cuts(kept.withColumn("a", F.col("f")).join(totals, "lang"))
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # the best of each slice of a language first, so that no task sorts a whole language
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(width))).orderBy(*best)
    scored = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("long").alias("score"))
