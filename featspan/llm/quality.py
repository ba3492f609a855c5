"""Quality classifier: regularised quadratic discriminant over document statistics.

Whole texts become a few shares and lengths, each transformed towards a bell shape and, as short
texts say little, drawn towards the mean of the labelled documents as if ``calm`` words of average
text were added. Each class gets a mean and a covariance shrunk towards a sphere; a score is the
logistic of the difference of Mahalanobis log densities, by Cholesky factors that are made once.

Sums over labelled rows are made in the tasks and added up per class, so that the driver sees
moments only. Null and empty texts have all statistics 0 and no words, so they score like the mean
text. Labels that are null, or rows without an id, teach nothing; equal labels of a document count
once. Without rows of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featspan.llm.storage import materialise

_MARKS = "!%$#*&|"
SHARES = ("distinct", "top", "lower", "upper", "letters", "repeated", "short", "bars", "repeated_lines", "longest_line")
RATES = ("word_length", "stops", "marks", "commas", "lines")
WIDTH = len(SHARES) + len(RATES)


def statistics_of(text: str | None) -> tuple[int, list[float]]:
    """Number of words, and transformed statistics: arcsine of shares, logarithm of rates."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return 0, [0.0] * WIDTH
    lines = text.split("\n")
    shares = (
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        sum(map(str.islower, words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(1 for w in words if len(w) <= 3) / n,
        words.count("|") / n,
        1 - len(set(lines)) / len(lines),
        max(map(len, lines)) / len(text),
    )
    rates = (
        len(text) / n,
        (text.count(".") + text.count("!") + text.count("?")) / n,
        sum(map(text.count, _MARKS)) / n,
        text.count(",") / n,
        len(lines) / n,
    )
    return n, [*(math.asin(math.sqrt(min(s, 1.0))) for s in shares), *map(math.log1p, rates)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and x, the statistics, of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [statistics_of(t) for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([x for _, x in made], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for tests: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    centre: np.ndarray
    calm: float
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]  # inverse Cholesky factors, per class
    offsets: tuple[float, ...]  # log prior less half the log determinant
    constant: float

    def calmed(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _calmed(x, n, self.centre, self.calm)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if not self.factors:
            return np.full(len(x), self.constant)
        z = self.calmed(x, n)
        log = [o - (((z - m) @ f.T) ** 2).sum(axis=1) / 2 for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _calmed(x: np.ndarray, n: np.ndarray, centre: np.ndarray, calm: float) -> np.ndarray:
    return centre + (x - centre) * (n / (n + calm))[:, None]


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    return first, n.astype(float), x


def _moments(rows: DataFrame, centre: np.ndarray | None, calm: float) -> dict[int, np.ndarray]:
    """Per class, the sum over its rows of the outer product of (1, x) with itself; texts' x calmed if there is a centre."""
    side = WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, side, side))
        for batch in batches:
            quality, n, x = _columns(batch)
            x = x if centre is None else _calmed(x, n, centre, calm)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                sums[k] += one[quality == k].T @ one[quality == k]
        keys = np.indices(sums.shape).reshape(3, -1)
        arrays = [pa.array(keys[0].astype(np.int32)), pa.array((keys[1] * side + keys[2]).astype(np.int32)), pa.array(sums.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, names=["quality", "cell", "value"])

    cells = rows.mapInArrow(run, "quality int, cell int, value double").groupBy("quality", "cell").agg(F.sum("value").alias("value"))
    out = {k: np.zeros((side, side)) for k in (0, 1)}
    for r in cells.collect():  # 2 x 16 x 16 numbers
        out[r["quality"]][divmod(r["cell"], side)] = r["value"]
    return out


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = 0.05, calm: float = 30.0) -> Discriminant:
    """Learn from labelled rows that are not held out. ``stats`` should be a written table."""
    taught = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    rows = materialise(stats.where(~held_out(F.col("doc_id"))).join(taught, "doc_id").select("quality", "n_words", "x"), "quality-rows")
    plain = _moments(rows, None, calm)
    counts = [plain[k][0, 0] for k in (0, 1)]
    if not all(counts):
        total = sum(counts)
        return Discriminant(np.zeros(WIDTH), calm, (), (), (), counts[1] / total if total else 0.5)
    centre = (plain[0][0, 1:] + plain[1][0, 1:]) / sum(counts)
    calmed = _moments(rows, centre, calm)
    means, factors, offsets = [], [], []
    both = (calmed[0] + calmed[1]) / sum(counts)
    scale = np.sqrt(np.maximum(np.diag(both)[1:] - both[0, 1:] ** 2, 1e-8))  # of each statistic over all rows
    for k in (0, 1):
        n, mean = counts[k], calmed[k][0, 1:] / counts[k]
        spread = (calmed[k][1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale)
        spread = (1 - shrinkage) * spread + shrinkage * max(np.trace(spread) / WIDTH, 1e-6) * np.eye(WIDTH)
        factor = np.linalg.cholesky(spread)
        means.append(mean)
        factors.append(np.linalg.inv(factor) / scale)
        offsets.append(math.log(n) - float(np.log(np.diag(factor)).sum()))
    return Discriminant(centre, calm, tuple(means), tuple(factors), tuple(offsets), 0.5)


def score(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) per row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, x = _columns(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x, n))], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", "n_words", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.05, calm: float = 30.0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = materialise(statistics(docs), "statistics")
    out = score(stats, fit(stats, labels, shrinkage, calm), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.05, calm: float = 30.0) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all columns; learnt from them and their labels.

    Texts stay where they are: the model goes to them, and their statistics are taken a second time.
    """
    model = fit(materialise(statistics(docs), "statistics"), labels, shrinkage, calm)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                made = [statistics_of(t) for t in part.column(at).to_pylist()]
                scores = model.score(np.array([x for _, x in made]), np.array([n for n, _ in made], float))
                yield part.filter(pa.array(scores >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
