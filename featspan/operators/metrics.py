"""Scores of a predicted table (label, prediction, probability array) as Spark aggregates.

All metrics come from one mergeable state: per class the hits, labels, predictions and, where the ROC
area is asked for, the pairs that are in order. Rows are folded to counts first, by class, score,
label and prediction; the scores' ranges are then summed up apart and put together from their totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featspan.session import shuffle_width

BINARY, MULTI, REGRESSION = "01-Class", "Multi-Class", "Regression"
METRICS = ("auc", "F1-score", "Acc")  # fixed values: metric names

#: Counts per class: rows predicted and labelled as it, labelled, predicted; and over all rows the right ones, and their number.
_COUNTS = ("hits", "labels", "predictions", "right", "rows")


def _folded(scored: DataFrame, task: str, with_scores: bool) -> DataFrame:
    """(class, score, counts): rows folded by class, score, label and prediction; two classes need one side only.

    Several classes are those with a probability, and those a row is labelled or predicted as.
    """
    label, prediction = F.col("label").cast("int"), F.col("prediction").cast("int")
    base = 1 if task == BINARY else 0
    if task == BINARY:
        classes = F.array(F.lit(1))
    else:
        listed = [F.size("probability") - 1] if with_scores else []
        classes = F.sequence(F.lit(0), F.greatest(*listed, label, prediction, F.lit(0)))
    score = F.get("probability", F.col("class")) if with_scores else F.lit(None)
    rows = scored.select(label.alias("label"), prediction.alias("prediction"), *(["probability"] if with_scores else []), F.explode(classes).alias("class"))
    rows = rows.select("class", score.cast("double").alias("score"), "label", "prediction")
    folded = rows.groupBy("class", "score", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    is_label, is_prediction, first = F.col("label") == F.col("class"), F.col("prediction") == F.col("class"), F.col("class") == base
    n = lambda when: F.when(when, F.col("n")).otherwise(0)
    return folded.select(
        "class", "score",
        n(is_label & F.col("score").isNotNull()).alias("pos"), n(~is_label & F.col("score").isNotNull()).alias("neg"),
        n(is_label & is_prediction).alias("hits"), n(is_label).alias("labels"), n(is_prediction).alias("predictions"),
        n(first & (F.col("label") == F.col("prediction"))).alias("right"), n(first).alias("rows"),
    )


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def class_state(scored: DataFrame, task: str, with_scores: bool = True) -> DataFrame:
    """One row per class: the counts and, with scores, pos, neg and wins, the pairs in order (ties are half).

    Scores are range partitioned, summed up within each range, and the ranges put together
    from their totals: no step sees all scores in one place.
    """
    folded = _folded(scored, task, with_scores)
    if not with_scores:
        return folded.groupBy("class").agg(*_sums(*_COUNTS))
    ranged = folded.repartitionByRange(shuffle_width(scored.sparkSession), "class", "score")
    by_score = ranged.groupBy("class", "score").agg(*_sums("pos", "neg", *_COUNTS)).withColumn("range", F.spark_partition_id())
    below = Window.partitionBy("class", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") * F.lit(0.5))
    parts = by_score.withColumn("wins", wins).groupBy("class", "range").agg(*_sums("wins", "pos", "neg", *_COUNTS))
    parts = parts.repartition(1)  # one row per class and range
    earlier = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    return parts.withColumn("wins", F.col("wins") + ahead).groupBy("class").agg(*_sums("wins", "pos", "neg", *_COUNTS))


def _value(name: str, task: str) -> Column:
    """A metric from the classes' state."""
    if name == "auc":
        # the mean over classes; one without both kinds of rows has no area and is left out
        return F.avg(F.try_divide(F.col("wins"), (F.col("pos") * F.col("neg")).cast("double")))
    if name == "Acc":
        return F.try_divide(F.sum("right").cast("double"), F.sum("rows"))
    f1 = F.try_divide(2.0 * F.col("hits"), F.col("labels") + F.col("predictions"))
    # of two classes the positive one, 0 when there is nothing to find and nothing found; else the mean over those seen
    return F.coalesce(F.max(f1), F.lit(0.0)) if task == BINARY else F.avg(f1)


def _one(scored: DataFrame, name: str, task: str) -> DataFrame:
    return class_state(scored, task, name == "auc").agg(_value(name, task).alias("value"))


def auc_binary(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of the positive class, ties counting half."""
    return _one(scored, "auc", BINARY)


def auc_macro(scored: DataFrame) -> DataFrame:
    """Unweighted mean over classes of the one-against-rest area; classes are in index order."""
    return _one(scored, "auc", MULTI)


def f1_positive(scored: DataFrame) -> DataFrame:
    """F1 of class 1; 0 when there is nothing to find and nothing found."""
    return _one(scored, "F1-score", BINARY)


def f1_macro(scored: DataFrame) -> DataFrame:
    """Unweighted mean of the F1 of every class seen as label or prediction."""
    return _one(scored, "F1-score", MULTI)


def accuracy(scored: DataFrame) -> DataFrame:
    """Share of rows predicted right."""
    return _one(scored, "Acc", BINARY)


def known(name: str, task: str) -> bool:
    return name in METRICS and task in (BINARY, MULTI)


def metric(scored: DataFrame, name: str, task: str, compatible: bool = True) -> DataFrame:
    """One metric as a one-row table (value)."""
    return metrics(scored, (name,), task, compatible).select(F.col("scores")[name].alias("value"))


def metrics(scored: DataFrame, names, task: str, compatible: bool = True) -> DataFrame:
    """Composite score: (score = sum of the listed metrics, scores = each by name), one row.

    Unknown metrics and regression tasks score 0, or raise when not ``compatible``.
    """
    found = [n for n in names if known(n, task)]
    if not compatible and len(found) < len(names):
        raise ValueError(f"no metric {next(n for n in names if n not in found)!r} for task {task!r}")
    zero = F.lit(0.0)
    if found:
        one = class_state(scored, task, "auc" in found).agg(*[_value(n, task).alias(n) for n in found])
    else:
        one = scored.sparkSession.range(1)
    values = {n: F.col(f"`{n}`") if n in found else zero for n in names}
    total = zero
    for value in values.values():
        total = total + F.coalesce(value, zero)
    listed = [x for n, value in values.items() for x in (F.lit(n), value)]
    return one.select(total.alias("score"), (F.create_map(*listed) if listed else F.create_map()).alias("scores"))
