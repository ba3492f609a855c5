"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents (``per_class`` of each class, those with the smallest hash of
their id) are the examples. Their words are the possible terms; those whose frequency among examples
(near copies counting once) differs between the classes by a factor of ``lift`` or more, at a false
discovery rate of ``discovery``, are the vocabulary, at most ``most_terms``. How many documents hold a
term is counted over all documents. A document's vector has (1 + ln tf) ln(1 + N / df) for each of its terms.

Examples are kept as an inverted index: postings per term, in blocks of ``BLOCK`` consecutive
examples, with the largest weight of the term in each block. A document's bound for a block is the
sum of its own weights times those maxima; blocks are visited by falling bounds until the bound is
below the similarity of the ``neighbours``-th example found so far, so the nearest examples are
exact. Ties go to the smaller doc_id. Examples are sorted by their strongest terms, so that like
ones share blocks and bounds are tight.

Neighbours vote with weights that fall with their distance. Votes are calibrated on the examples
themselves, each judged by the others: a monotone step function from votes to the share of toxic
examples, with every example standing for the labelled rows of its class that it was drawn for. A
document that shares no term with any example gets the share among such examples. The neighbours
are the evidence.

The index is at most ``2 * per_class`` examples times ``most_terms``, so it can be sent to every
task. Null and empty texts have no terms. Labels other than 0 and 1, without an id, or of an id that
has both, teach nothing; an id with several texts teaches one of them, and equal texts of a class are
one example that counts as often as it was drawn. A document is never its own evidence, nor is a row that repeats its id. Without labels every
score is 0. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featspan.llm.spans import span_hashes, word_spans
from featspan.llm.storage import materialise
from featspan.llm.text import U64, bytes_of, slices

#: Bytes that words are made of: letters, digits and everything beyond ASCII.
_LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
BLOCK = 64
_SCORED = "doc_id long, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>"


@dataclass(frozen=True)
class Settings:
    per_class: int = 4096
    most_terms: int = 1024
    lift: float = 3.0
    discovery: float = 0.01
    neighbours: int = 15


def training_rows(doc_id: Column) -> Column:
    """Whether labels of this id may be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) != 1


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each text, by row and term."""
    data, offsets = bytes_of(pc.utf8_lower(texts))
    starts, lengths, rows = word_spans(_LETTERS[data], offsets)
    if not len(starts):
        return rows, np.zeros(0, U64), rows
    hashes = span_hashes(data, starts, lengths)
    return _counted(rows, hashes)


def _counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else rows[:0]
    return rows[new], terms[new], np.diff(np.append(new, len(rows)))


def known_terms(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``term_counts``, for the terms of the sorted ``vocabulary`` only, by their places in it."""
    data, offsets = bytes_of(pc.utf8_lower(texts))
    starts, lengths, rows = word_spans(_LETTERS[data], offsets)
    if not len(starts) or not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = span_hashes(data, starts, lengths)
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[place] == hashes
    return _counted(rows[known], place[known])


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """The drawn (doc_id, toxic) with their texts, and how many ids of each class there are and were drawn."""
    label = F.col("toxic").cast("int")
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("toxic"))
    named = named.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & training_rows(F.col("doc_id")))
    named = named.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    named = materialise(named, "toxic-labels")
    there = {r.toxic: r["count"] for r in named.groupBy("toxic").count().collect()}
    drawn = [named.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class) for c in (0, 1)]
    drawn = materialise(drawn[0].unionByName(drawn[1]), "toxic-drawn")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id"), there, {c: min(n, settings.per_class) for c, n in there.items()}


def _examples(sample: DataFrame) -> DataFrame:
    """doc_id, toxic, times, terms and counts of each example; equal texts of a class are one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch, "text"):
                part = batch.slice(at, n)
                rows, terms, counts = term_counts(part.column("text"))
                ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("toxic"),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(terms.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32))),
                    ],
                    names=["doc_id", "toxic", "terms", "counts"],
                )

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    one = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(key.alias("key"), "text")).alias("m")).select("doc_id", "toxic", "m.key", "m.text")
    one = materialise(one, "toxic-sample")
    alike = one.groupBy("toxic", "key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times")).drop("key")
    counted = one.drop("key").mapInArrow(count, "doc_id long, toxic int, terms array<long>, counts array<int>")
    return materialise(counted.join(alike, ["doc_id", "toxic"]), "toxic-examples")


def _vocabulary(examples: DataFrame, settings: Settings) -> np.ndarray:
    """The hashes of the terms that tell the classes apart, sorted."""
    held = materialise(examples.select("doc_id", "toxic", F.explode("terms").alias("term")), "toxic-held")
    # near copies count as one example here: they share the smallest of their rare terms
    rare = held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max(2, settings.per_class // 64)).select("term")
    alike = held.join(rare, "term").groupBy("doc_id", "toxic").agg(F.min("term").alias("alike"))
    alike = materialise(examples.select("doc_id", "toxic").join(alike, ["doc_id", "toxic"], "left").na.fill(0, ["alike"]), "toxic-alike")
    n = {r.toxic: r.n for r in alike.groupBy("toxic").agg(F.countDistinct("alike").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, U64)
    per_term = held.join(alike, ["doc_id", "toxic"]).select("term", "toxic", "alike").distinct().groupBy("term").agg(
        F.sum("toxic").cast("double").alias("x"), F.sum(1 - F.col("toxic")).cast("double").alias("y")
    )
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    x, y, all_n = F.col("x"), F.col("y"), float(n0 + n1)
    both, gap = x + y, all_n - F.col("x") - F.col("y")
    ratio = 2 * (
        part(x, both * n1 / all_n) + part(y, both * n0 / all_n)
        + part(n1 - x, F.greatest(gap, F.lit(1e-9)) * n1 / all_n) + part(n0 - y, F.greatest(gap, F.lit(1e-9)) * n0 / all_n)
    )
    lift = (x + 0.5) / (n1 + 1) / ((y + 0.5) / (n0 + 1))
    tested = materialise(per_term.select("term", ratio.alias("g"), lift.alias("lift")), "toxic-terms")
    terms = tested.count()
    best = tested.where((F.col("lift") >= settings.lift) | (F.col("lift") <= 1 / settings.lift))
    best = best.orderBy(F.col("g").desc(), "term").limit(settings.most_terms).collect()
    # step-up control over all terms; the p value of a log-likelihood ratio is that of a chi-squared with one degree
    p = [erfc(sqrt(max(r.g, 0.0) / 2)) for r in best]
    passed = max((k + 1 for k, q in enumerate(p) if q * terms <= settings.discovery * (k + 1)), default=0)
    return np.sort(np.array([r.term for r in best[:passed]], np.int64).view(U64))


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            total += batch.num_rows
            for at, n in slices(batch, "text"):
                seen += np.bincount(known_terms(batch.column("text").slice(at, n), vocabulary)[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(vocabulary))), pa.array(np.append(total, seen))], ["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_term = {r.term: r.n for r in rows.collect()}
    return by_term.get(-1, 0), np.array([by_term.get(i, 0) for i in range(len(vocabulary))], np.int64)


class Index:
    """Postings of the examples, in blocks with the largest weight of each term."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, share: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        """``vectors`` are places in the vocabulary and weights of unit length, ``share`` what an example stands for."""
        strongest = [tuple(-1 - v[0][np.lexsort((v[0], -v[1]))][:4]) for v in vectors]
        order = sorted(range(len(ids)), key=lambda i: (strongest[i], ids[i]))
        self.ids, self.toxic, self.share = ids[order], toxic[order], share[order]
        self.blocks = -(-len(order) // BLOCK)
        sizes = [len(vectors[i][0]) for i in order]
        at = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((at, term))
        self.at, self.weight = at[by], weight[by]
        #: where the postings of a term in a block begin
        self.edges = np.searchsorted(term[by] * (self.blocks + 1) + self.at // BLOCK, np.arange(terms * (self.blocks + 1) + 1))
        self.top = np.zeros((terms, self.blocks))
        np.maximum.at(self.top, (term[by], self.at // BLOCK), self.weight)

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int, but: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest positive cosine and these, ties by id; none with the id ``but``."""
        bounds = weights @ self.top[places]
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        least = 0.0
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or bounds[block] < least - 1e-9:
                break
            scores = np.zeros(BLOCK)
            for place, weight in zip(places.tolist(), weights.tolist(), strict=True):
                edge = place * (self.blocks + 1) + block
                low, high = self.edges[edge], self.edges[edge + 1]
                scores[self.at[low:high] - block * BLOCK] += weight * self.weight[low:high]
            on = np.flatnonzero(scores)
            at, scores = on + block * BLOCK, scores[on]
            if but is not None:
                other = self.ids[at] != but
                at, scores = at[other], scores[other]
            found_at, found = np.append(found_at, at), np.append(found, scores)
            if len(found) > k:
                best = np.lexsort((self.ids[found_at], -found))[:k]
                found_at, found = found_at[best], found[best]
            if len(found) == k:
                least = found.min()
        best = np.lexsort((self.ids[found_at], -found))
        return found_at[best], np.minimum(found[best], 1.0)

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic share of the neighbours' votes; a vote falls with the distance 1 - cosine."""
        weights = self.share[at] * cosines / (1.05 - cosines)
        return float(weights @ self.toxic[at] / weights.sum())


def unit(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf[places]
    return weights / np.sqrt(weights @ weights)


def monotone(votes: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of votes and the toxic share up to each: neighbouring votes are pooled until shares rise."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(votes[order], toxic[order], share[order], strict=True):
        pools.append([v, w * y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            v, y, w = pools.pop()
            pools[-1] = [v, pools[-1][1] + y, pools[-1][2] + w]
    return np.array([p[0] for p in pools]), np.array([(p[1]) / (p[2]) for p in pools])


@dataclass
class Judge:
    """What tasks need to score a text."""

    vocabulary: np.ndarray
    idf: np.ndarray
    index: Index
    steps: tuple[np.ndarray, np.ndarray]
    without: float
    neighbours: int

    def score(self, places: np.ndarray, counts: np.ndarray, but: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        if len(places):
            at, cosines = self.index.nearest(places, unit(places, counts, self.idf), self.neighbours, but)
            if len(at):
                step = min(int(np.searchsorted(self.steps[0], self.index.vote(at, cosines) - 1e-12)), len(self.steps[0]) - 1)
                return float(self.steps[1][step]), at, cosines
        return self.without, np.zeros(0, np.int64), np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Judge:
    """Learn the vocabulary, the index and the calibration from the labelled ``docs``."""
    sample, there, drawn = _sample(docs, labels, settings)
    examples = _examples(sample)
    vocabulary = _vocabulary(examples, settings)
    n, df = _document_counts(docs, vocabulary)
    idf = np.log1p(n / np.maximum(df, 1))
    known = np.array(vocabulary.view(np.int64))
    kept = F.filter(F.arrays_zip("terms", "counts"), lambda x: x["terms"].isin(*known.tolist()) if len(known) else F.lit(False))
    rows = examples.select("doc_id", "toxic", "times", kept.alias("kept")).collect()
    # an example stands for the labelled ids of its class that it was drawn for
    share = {c: there[c] / drawn[c] for c in there}
    with_terms, empty = [], [0.0, 0.0]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic)):
        if not r.kept:
            empty[r.toxic] += r.times * share[r.toxic]
            continue
        places = np.searchsorted(vocabulary, np.array([x["terms"] for x in r.kept], np.int64).view(U64))
        counts = np.array([x["counts"] for x in r.kept], np.int64)
        by = np.argsort(places)
        with_terms.append((r.doc_id, r.toxic, r.times * share[r.toxic], places[by], counts[by]))
    column = lambda i, kind: np.array([x[i] for x in with_terms], kind)
    index = Index(
        column(0, np.int64), column(1, np.int64), column(2, np.float64),
        [(x[3], unit(x[3], x[4], idf)) for x in with_terms], len(vocabulary),
    )
    without = empty[1] / sum(empty) if sum(empty) else 0.0
    # calibrate on the examples, each without itself
    judge = Judge(vocabulary, idf, index, (np.array([1.0]), np.array([0.0])), without, settings.neighbours)
    votes, toxic, stand = [], [], []
    for doc_id, y, w, places, counts in with_terms:
        at, cosines = index.nearest(places, unit(places, counts, idf), settings.neighbours, doc_id)
        if len(at):
            votes.append(index.vote(at, cosines))
            toxic.append(y)
            stand.append(w)
    if votes:
        judge.steps = monotone(np.array(votes), np.array(toxic, float), np.array(stand))
    return judge


def score_toxicity(docs: DataFrame, judge: Judge) -> DataFrame:
    """doc_id, score and evidence (doc_id, cosine and label of the nearest examples) for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = sent.value
        index = judge.index
        for batch in batches:
            for start, n in slices(batch, "text"):
                part = batch.slice(start, n)
                rows, places, counts = known_terms(part.column("text"), judge.vocabulary)
                edges = np.searchsorted(rows, np.arange(n + 1)).tolist()
                scores, evidence = [], []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    low, high = edges[i], edges[i + 1]
                    value, at, cosines = judge.score(places[low:high], counts[low:high], doc_id)
                    scores.append(value)
                    found = zip(index.ids[at].tolist(), cosines.tolist(), index.toxic[at].tolist(), strict=True)
                    evidence.append([{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in found])
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, _SCORED)


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for every row of ``docs``."""
    scored = score_toxicity(docs, fit(docs, labels, settings))
    held = F.coalesce(~training_rows(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
