"""Ranking candidates by what earlier trials say about features like them.

Histories hold at most rounds x features rows; candidates are the sampled pool. Expected values are
shrunken effects of attributes and their combinations (operators/effects.py), or mean lifts between
the steps of a path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featspan.functions.scalars import unit_hash
from featspan.operators.effects import add_expected, fit_effects, with_attributes
from featspan.operators.sampling import FIELDS, biased_weight, draw_order

TOP = 10  # fixed value: a path step picks among this many
ROUNDING = 12  # expected values this close are equal

#: What a single feature's value is made of: its parts, then column with method and window, then all of it.
SINGLE_STAGES = (
    ("at_column",),
    ("at_method",),
    ("at_band",),
    ("at_window",),
    ("at_column", "at_method"),
    ("at_column", "at_band"),
    ("at_column", "at_method", "at_window"),
)
#: The same for a feature (y) that follows another (x): each side alone, then across the sides.
PAIR_STAGES = (
    ("y_at_column",),
    ("y_at_method",),
    ("y_at_band",),
    ("x_at_column",),
    ("x_at_method",),
    ("x_at_column", "y_at_column"),
    ("x_at_method", "y_at_method"),
    ("x_at_column", "y_at_method"),
    ("x_at_method", "y_at_column"),
    ("x_at_column", "x_at_method", "x_at_window", "y_at_column", "y_at_method", "y_at_window"),
)


def _best_first(df: DataFrame) -> DataFrame:
    return df.select(*FIELDS, "position", "expected").orderBy(F.col("expected").desc(), "position")


def _seen(history: DataFrame) -> Column:
    return F.col("info_num") if "info_num" in history.columns else F.lit(1.0)


def rank_candidates(history: DataFrame, pool: DataFrame, by: str = "score") -> DataFrame:
    """Pool with its expected value, best first, of equal ones the one drawn earlier.

    Without a history every expected value is 0.
    ``history``: scheme fields plus score_max, score_avg, imp_max, imp_avg per feature, and how many
    trials that rests on (info_num), if known.
    ``by``: "score" (score_max + score_avg), "imp" (imp_max + imp_avg), or "both"
    (score_avg * imp_avg + score_avg).
    """
    targets = {"score": ["score_max", "score_avg"], "imp": ["imp_max", "imp_avg"], "both": ["score_avg", "imp_avg"]}[by]
    effects = fit_effects(with_attributes(history), SINGLE_STAGES, targets, weight=_seen(history))
    guessed = add_expected(with_attributes(pool), "position", effects, SINGLE_STAGES, targets)
    a, b = (F.col(f"{t}_hat") for t in targets)
    value = a * b + a if by == "both" else a + b
    return _best_first(guessed.withColumn("expected", F.round(value, ROUNDING)))


def _side(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    named = with_attributes(df, prefix)
    return named.select(*keep, *[c for c in named.columns if c.startswith(f"{prefix}at_")])


def rank_pairs(pairs: DataFrame, schemes: DataFrame, keys: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates by the expected score of following a key scheme.

    ``pairs`` (parent, child, score_max, score_avg, and info_num if known) is the history; ``schemes`` resolves names. ``keys``
    (draw, scheme fields) and ``pool`` (position, scheme fields) are matched draw by draw, and
    a candidate drawn several times counts by its best pair. What a candidate is worth depends on
    the key it follows, as far as the history tells them apart. Equal ones are in draw order, and
    without pairs or keys every candidate is worth 0.
    """
    targets = ["score_max", "score_avg"]
    named = schemes.select("feature", "column", "rule", "method", "parts").distinct()
    parents = _side(named.withColumnRenamed("feature", "parent"), "x_", "parent")
    children = _side(named.withColumnRenamed("feature", "child"), "y_", "child")
    train = pairs.join(parents, "parent").join(children, "child")
    effects = fit_effects(train, PAIR_STAGES, targets, weight=_seen(pairs))
    right = _side(pool.withColumnRenamed("position", "draw"), "y_", "draw", *FIELDS)
    left = _side(keys.select("draw", "column", "rule", "method", "parts"), "x_", "draw")
    matched = add_expected(right.join(left, "draw"), "draw", effects, PAIR_STAGES, targets)
    value = F.round(F.col("score_max_hat") + F.col("score_avg_hat"), ROUNDING)
    worth = right.select("draw", *FIELDS).join(matched.select("draw", value.alias("value")), "draw", "left")
    best = worth.groupBy(*FIELDS).agg(F.min("draw").alias("position"), F.coalesce(F.max("value"), F.lit(0.0)).alias("expected"))
    return _best_first(best)


# Attributes of a step whose transitions are compared.
STEP_KEYS = {
    "column": lambda p: F.col(f"{p}column"),
    "method": lambda p: F.concat_ws("/", F.col(f"{p}rule"), F.col(f"{p}method")),
    "parts": lambda p: F.concat_ws("/", F.col(f"{p}rule"), F.col(f"{p}parts").cast("string")),
}
START = "None"  # fixed value: the step before the first


def step_lifts(paths: DataFrame) -> DataFrame:
    """Mean gain of trials that take a step, by (kind, previous, next).

    ``paths``: (trial, position, scheme fields, gain), one row per step.
    """
    here = paths.alias("b")
    before = paths.select(
        F.col("trial").alias("p_trial"),
        (F.col("position") + 1).alias("p_position"),
        *[F.col(c).alias(f"p_{c}") for c in ("column", "rule", "method", "parts")],
    )
    match = (F.col("trial") == F.col("p_trial")) & (F.col("position") == F.col("p_position"))
    steps = here.join(before, match, "left")
    first = F.col("p_trial").isNull()
    kinds = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.when(first, START).otherwise(of("p_")).alias("prev"),
            of("").alias("next"),
        )
        for kind, of in STEP_KEYS.items()
    ]
    return (
        steps.select("gain", F.inline(F.array(*kinds)))
        .groupBy("kind", "prev", "next")
        .agg(F.avg("gain").alias("lift"))
    )


def first_step(lifts: DataFrame, pool: DataFrame) -> DataFrame:
    """Pool with the lift of starting a path with each candidate, best first."""
    out, total = pool, F.lit(0.0)
    for kind, of in STEP_KEYS.items():
        part = lifts.where((F.col("kind") == kind) & (F.col("prev") == START))
        part = part.select(F.col("next").alias("__to"), F.col("lift").alias(f"__{kind}_lift"))
        out = out.withColumn("__next", of("")).join(part, F.col("__next") == F.col("__to"), "left").drop("__to", "__next")
        total = total + F.coalesce(F.col(f"__{kind}_lift"), F.lit(0.0))
    return _best_first(out.withColumn("expected", F.round(total, ROUNDING)))


def _codes(lifts: DataFrame) -> DataFrame:
    """(kind, value, code): the values of each kind numbered from 1. No more than the catalogue has."""
    values = lifts.select("kind", F.explode(F.array("prev", "next")).alias("value"))
    values = values.unionByName(lifts.select("kind", F.lit(START).alias("value"))).distinct()
    return values.withColumn("code", F.row_number().over(Window.partitionBy("kind").orderBy("value")))


def _matrices(lifts: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: per kind the lifts by codes of previous and next step, and the code of the start."""
    prev = codes.select("kind", F.col("value").alias("prev"), F.col("code").alias("p"))
    following = codes.select("kind", F.col("value").alias("next"), F.col("code").alias("q"))
    cells = prev.join(following, "kind").join(lifts, ["kind", "prev", "next"], "left")
    sorted_by = lambda at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    lines = cells.withColumn("lift", F.coalesce("lift", F.lit(0.0))).groupBy("kind", "p").agg(sorted_by("q", "lift").alias("line"))
    tables = lines.groupBy("kind").agg(sorted_by("p", "line").alias("table"))
    start = codes.where(F.col("value") == START).select("kind", F.col("code").alias("start"))
    tables = tables.join(start, "kind")
    return tables.agg(
        *[F.max(F.when(F.col("kind") == k, F.col("start"))).alias(f"{k}_start") for k in STEP_KEYS],
        *[F.max_by("table", F.col("kind") == k).alias(f"{k}_table") for k in STEP_KEYS],
    )


def path_draws(candidates: DataFrame, key_columns: DataFrame | Sequence[str], steps: int, size: int, seed: str) -> DataFrame:
    """The pool of every step: ``size`` candidates by a biased draw each; step, scheme fields, position."""
    spread = biased_weight(candidates, key_columns).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    salted = F.concat(F.col("feature"), F.lit(f"{seed}/path"), F.col("step").cast("string"))
    drawn = spread.withColumn("__of", salted).withColumn("__draw", draw_order(F.col("weight"), "", "__of"))
    order = Window.partitionBy("step").orderBy("__draw", "feature")  # no more than the catalogue per step
    return drawn.withColumn("position", F.row_number().over(order)).where(F.col("position") <= size).select("step", *FIELDS, "position")


def _pick(position: Column, step: Column, seed: str, size: Column) -> Column:
    """Which of ``size`` entries the path at ``position`` takes in ``step``, from 0."""
    return F.floor(unit_hash(position, step, salt=f"/{seed}") * size).cast("int")


def grow_paths(lifts: DataFrame, draws: DataFrame, paths: int, seed: str) -> DataFrame:
    """(path, step, feature) of ``paths`` paths, grown step by step in one job.

    In a step, every candidate of the step's pool continues the path of its number: its worth is the lift
    of stepping to it from what that path took before. Of the ``TOP`` best of the step each path takes one by hash.
    All pools (steps times pool rows) and the lifts, as matrices over codes, meet in one row, and the
    steps are one fold over it. Without lifts no path grows.
    """
    codes = _codes(lifts)
    coded = draws
    for kind, of in STEP_KEYS.items():
        part = codes.where(F.col("kind") == kind).select(F.col("value").alias("__value"), F.col("code").alias(kind + "_code"))
        coded = coded.withColumn("__key", of("")).join(part, F.col("__key") == F.col("__value"), "left").drop("__key", "__value")
    names = [f"{k}_code" for k in STEP_KEYS]
    row = F.struct("position", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "feature")
    pools = coded.groupBy("step").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    whole = pools.agg(F.array_sort(F.collect_list(F.struct("step", "rows"))).alias("steps")).crossJoin(_matrices(lifts, codes))
    state = "struct<prev:array<struct<" + ",".join(f"{n}:int" for n in names) + ">>,picks:array<struct<path:int,step:int,feature:string>>>"
    begin = F.struct(F.array(F.struct(*[F.col(f"{k}_start").alias(f"{k}_code") for k in STEP_KEYS])).alias("prev"), F.array().alias("picks"))

    def step(done: Column, now: Column) -> Column:
        def worth(r: Column) -> Column:
            at = F.get(done["prev"], _pick(r["position"], now["step"] - 1, seed, F.size(done["prev"])))
            total = F.lit(0.0)
            for k in STEP_KEYS:
                total = total + F.coalesce(F.get(F.get(F.col(f"{k}_table"), at[f"{k}_code"] - 1), r[f"{k}_code"] - 1), F.lit(0.0))
            return F.struct((-F.round(total, ROUNDING)).alias("worth"), *[r[n].alias(n) for n in ("position", *names, "feature")])

        top = F.slice(F.array_sort(F.transform(now["rows"], worth)), 1, TOP)
        took = F.transform(
            F.sequence(F.lit(1), F.lit(paths)),
            lambda p: F.struct(
                p.alias("path"), now["step"].alias("step"), F.get(top, _pick(p, now["step"], seed, F.size(top)))["feature"].alias("feature")
            ),
        )
        prev = F.transform(top, lambda x: F.struct(*[x[n].alias(n) for n in names]))
        return F.struct(prev.alias("prev"), F.concat(done["picks"], took).alias("picks")).cast(state)

    grown = F.aggregate("steps", begin.cast(state), step)
    return whole.where(F.col("column_start").isNotNull()).select(F.inline(grown["picks"]))
