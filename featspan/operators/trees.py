"""Statistics of fitted trees. A node table has (tree, id, feature, left, right); leaves have no feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from featspan.functions.scalars import unit_hash


def split_counts(nodes: DataFrame) -> DataFrame:
    """How often each feature splits a node, most often first."""
    counts = nodes.where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
    # One row per feature of a scheme.
    order = Window.orderBy(F.col("splits").desc(), "feature")
    return counts.withColumn("rank", F.row_number().over(order))


def with_unused(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """All columns (feature) with their split counts, 0 for those no tree uses."""
    return columns.join(counts.select("feature", "splits"), "feature", "left").withColumn(
        "splits", F.coalesce("splits", F.lit(0))
    )


def split_order(nodes: DataFrame) -> DataFrame:
    """Features by the first node that uses them; nodes are ordered by tree and pre-order id."""
    first = nodes.where("feature is not null").groupBy("feature").agg(F.min(F.struct("tree", "id")).alias("at"))
    # One row per feature of a scheme.
    return first.withColumn("position", F.row_number().over(Window.orderBy("at"))).select("feature", "position")


def _parents(nodes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Split nodes whose both children split, with the children's features."""
    splits = nodes.where("feature is not null")
    left = splits.select(*by, "tree", F.col("id").alias("left"), F.col("feature").alias("yes"))
    right = splits.select(*by, "tree", F.col("id").alias("right"), F.col("feature").alias("no"))
    return splits.join(left, [*by, "tree", "left"]).join(right, [*by, "tree", "right"])


def split_pairs(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(parent, child) features with the number of times they meet; both children count.

    ``by`` names columns that tell forests apart, such as the trial.
    """
    return (
        _parents(nodes, by)
        .select(*by, F.col("feature").alias("parent"), F.explode(F.array("yes", "no")).alias("child"))
        .groupBy(*by, "parent", "child")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def negative_pairs(
    nodes: DataFrame, columns: list[str] | str, neg_num: int = 2, seed: int | str = 0, by: tuple[str, ...] = ()
) -> DataFrame:
    """Per parent node of ``split_pairs``, ``neg_num`` features that are neither child, drawn by hash.

    ``columns`` are the features of the scheme, or the name of an array column holding them; the
    draw happens within the row.
    """
    listed = F.col(columns) if isinstance(columns, str) else F.array(*[F.lit(c) for c in columns])
    others = F.array_except(listed, F.array("yes", "no"))
    shuffled = F.array_sort(
        F.transform(
            others,
            lambda c: F.struct(
                unit_hash(*by, "tree", "id", c, salt=str(seed)).alias("u"),
                c.alias("child"),
            ),
        )
    )
    return (
        _parents(nodes, by)
        .select(*by, F.col("feature").alias("parent"), F.explode(F.slice(shuffled, 1, neg_num)).alias("drawn"))
        .groupBy(*by, "parent", F.col("drawn.child").alias("child"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def pair_history(positive: DataFrame, negative: DataFrame, trials: DataFrame) -> DataFrame:
    """Score history of each feature pair over all trials.

    A meeting scores the trial's validation score and a negative draw 0; both count in
    the mean, only meetings in the maximum, which is never below 0.
    """
    scored = positive.join(trials.select("trial", "valid"), "trial")
    rows = scored.select("parent", "child", "times", "valid").unionByName(
        negative.select("parent", "child", "times", F.lit(0.0).alias("valid"))
    )
    return rows.groupBy("parent", "child").agg(
        F.greatest(F.max("valid"), F.lit(0.0)).alias("score_max"),
        (F.sum(F.col("valid") * F.col("times")) / F.sum("times")).alias("score_avg"),
        F.sum("times").alias("info_num"),
    )
