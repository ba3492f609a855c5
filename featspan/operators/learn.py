"""Design matrices, Spark ML fits, scored tables and node tables of fitted trees."""

from __future__ import annotations

import random
import uuid
from functools import reduce

from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from featspan.config import TaskConfig
from featspan.functions.scalars import fill_zero
from featspan.operators.metrics import BINARY, MULTI, REGRESSION
from featspan.session import work_dir


def shuffled(columns: list[str], seed: int) -> list[str]:
    """Feature columns in a seeded random order."""
    out = list(columns)
    random.Random(seed).shuffle(out)
    return out


def align_columns(table: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """``key`` and exactly ``columns``; features the table lacks are constant 0."""
    have = set(table.columns)
    return table.select(
        *key, *[F.col(f"`{c}`") if c in have else F.lit(0.0).alias(c) for c in columns]
    )


def design_matrix(table: DataFrame, columns: list[str], label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """(label, features vector, kept columns), nothing collected. Sort it when exporting, not for fitting."""
    key = [label, *[k for k in keep if k != label]]
    filled = fill_zero(align_columns(table, columns, key))
    wide = VectorAssembler(inputCols=columns, outputCol="features").transform(filled)
    return wide.select(F.col(label).cast("int").alias("label"), "features", *[k for k in keep if k != label])


def export_matrix(table: DataFrame, columns: list[str], order: str = "row_num") -> DataFrame:
    """Plain (label, features...) rows, latest row number first."""
    rows = fill_zero(align_columns(table, columns, ["label", order]))
    return rows.orderBy(F.col(order).desc()).drop(order)


def fit(matrix: DataFrame, config: TaskConfig, valid: DataFrame | None = None):
    """Fit boosted trees to (label, features); several classes are boosted one against the rest.

    All ``boost_rounds`` are fitted. Only with ``config.patience`` and held-out rows the ensemble ends
    at the round of least held-out loss, looking no further than that many rounds without gain.
    """
    learner = _learner(config, config.boost_rounds)
    if config.task == BINARY:
        weight = F.when(F.col("label") == 1, config.positive_weight).otherwise(1.0)
        matrix = matrix.withColumn("weight", weight)
    model = learner.fit(matrix)
    if config.patience is None or valid is None:
        return model
    rounds = best_round(_losses(model, valid, config), config.patience)
    # the same seed grows the same first trees
    return model if rounds == config.boost_rounds else _learner(config, rounds).fit(matrix)


def _learner(config: TaskConfig, rounds: int):
    common = {
        "maxDepth": config.depth,
        "seed": config.seed,
        "subsamplingRate": config.subsample,
        "maxIter": rounds,
        "stepSize": config.step,
        "featureSubsetStrategy": str(config.column_share),
    }
    if config.task == BINARY:
        return GBTClassifier(weightCol="weight", **common)
    if config.task == MULTI:
        return OneVsRest(classifier=GBTClassifier(**common))
    if config.task == REGRESSION:
        return GBTRegressor(**common)
    raise ValueError(f"unknown task {config.task!r}")


def best_round(losses: list[float], patience: int) -> int:
    """Number of rounds up to the least loss, stopping after ``patience`` rounds without a smaller one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _losses(model, valid: DataFrame, config: TaskConfig) -> list[float]:
    """Held-out loss after each round; over all classes where there are several."""
    if config.task == REGRESSION:
        return model.evaluateEachIteration(valid, "squared")
    if config.task == BINARY:
        return model.evaluateEachIteration(valid.withColumn("weight", F.lit(1.0)))
    each = [
        m.evaluateEachIteration(valid.withColumn("label", (F.col("label") == k).cast("double")))
        for k, m in enumerate(model.models)
    ]
    return [sum(losses) for losses in zip(*each, strict=True)]


def score(model, matrix: DataFrame, task: str) -> DataFrame:
    """(label, prediction, probability array) of a matrix; regression has no probabilities.

    One-against-rest margins become probabilities by the logistic function, scaled to sum to 1.
    """
    out = model.transform(matrix)
    if task == REGRESSION:
        probability = F.lit(None).cast("array<double>")
    elif task == MULTI:
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        out = out.withColumn("__each", each)
        total = F.aggregate("__each", F.lit(0.0), lambda a, x: a + x)
        probability = F.transform("__each", lambda x: x / total)
    else:
        probability = vector_to_array("probability")
    return out.select("label", "prediction", probability.alias("probability"))


def node_table(model, spark, columns: list[str]) -> DataFrame:
    """Nodes (tree, id, feature, left, right) of a fitted tree ensemble, read back from its saved form.

    The trees of one-against-rest models are numbered on from class to class.
    """
    parts, before = [], 0
    for one in getattr(model, "models", [model]):
        path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
        one.write().save(path)
        parts.append(_nodes_at(spark, path, columns, before))
        before += one.getNumTrees
    return reduce(DataFrame.unionByName, parts)


def _nodes_at(spark, path: str, columns: list[str], before: int) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    data = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData")
    split = node["leftChild"] >= 0
    return data.select(
        (F.col("treeID") + before).cast("bigint").alias("tree"),
        node["id"].cast("bigint").alias("id"),
        F.when(split, F.get(names, node["split"]["featureIndex"])).alias("feature"),
        F.when(split, node["leftChild"]).cast("bigint").alias("left"),
        F.when(split, node["rightChild"]).cast("bigint").alias("right"),
    )
