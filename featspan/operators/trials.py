"""Questions to the trial ledger.

``trials`` has one row per trial (trial, valid, test); the long ``ledger`` one row per trial and
feature with its split count. Both are bounded by rounds times features per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TS_TASK = "public_ts_"  # fixed value: prefix of time-series tasks
POOL_CAP = 100  # fixed value: length of the key scheme pool


def trial_scores(ledger: DataFrame) -> DataFrame:
    return ledger.select("trial", "valid", "test").distinct()


def ts_override(trials: DataFrame, task: str) -> DataFrame:
    """Time-series tasks are ranked by their test score."""
    if task.startswith(TS_TASK):
        return trials.withColumn("valid", F.col("test"))
    return trials


def top_trials(trials: DataFrame, k: int) -> DataFrame:
    """The k best trials by validation score; of equal ones the earlier."""
    return trials.orderBy(F.col("valid").desc(), "trial").limit(k)


def best_trial(trials: DataFrame, k: int) -> DataFrame:
    """Of the k best by validation score the one with the best test score."""
    return top_trials(trials, k).orderBy(F.col("test").desc(), F.col("valid").desc(), "trial").limit(1)


def record_trials(trials: DataFrame) -> DataFrame:
    """Trials that beat every earlier one when they ran."""
    # One row per trial.
    earlier = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max("valid").over(earlier)
    return trials.withColumn("__before", best_before).where("__before is null or valid > __before").drop("__before")


def used_ranked(ledger: DataFrame) -> DataFrame:
    """Features some tree splits on, ranked per trial by split count (ties by name)."""
    order = Window.partitionBy("trial").orderBy(F.col("splits").desc(), "column")
    return ledger.where("splits > 0").withColumn("rank", F.row_number().over(order))


def key_schemes(ledger: DataFrame) -> DataFrame:
    """Used features of the best trial, most splits first."""
    latest = record_trials(trial_scores(ledger)).agg(F.max("trial").alias("trial"))
    return used_ranked(ledger.join(latest, "trial")).select("column", "splits", "rank")


def key_pool(ledger: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """The pool after all trials: each record trial appends its used features that are not in
    it, then the pool keeps its last ``cap`` entries.

    Only record trials enter, each as one array as long as a scheme.
    """
    records = record_trials(trial_scores(ledger)).select("trial")
    lists = (
        used_ranked(ledger.join(records, "trial"))
        .groupBy("trial")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "column"))), lambda r: r["column"]).alias("used"))
    )
    steps = lists.agg(F.array_sort(F.collect_list(F.struct("trial", "used"))).alias("steps"))

    def append(pool, step):
        longer = F.concat(pool, F.array_except(step["used"], pool))
        return F.slice(longer, F.greatest(F.size(longer) - cap, F.lit(0)) + 1, F.lit(cap))

    pool = F.aggregate("steps", F.array().cast("array<string>"), append)
    return steps.select(F.posexplode(pool).alias("position", "column")).select(
        "column", (F.col("position") + 1).alias("position")
    )


def feature_history(ledger: DataFrame) -> DataFrame:
    """Per feature over all trials: best and mean score and importance, and the number of trials.

    Importance is a tenth of the split count, or -1 for a feature no tree used; such a trial
    also scores 0. Maxima start at 0.
    """
    used = F.col("splits") > 0
    score = F.when(used, F.col("valid")).otherwise(F.lit(0.0))
    imp = F.when(used, F.col("splits") / 10).otherwise(F.lit(-1.0))
    return ledger.groupBy("column").agg(
        F.greatest(F.max(score), F.lit(0.0)).alias("score_max"),
        F.avg(score).alias("score_avg"),
        F.greatest(F.max(imp), F.lit(0.0)).alias("imp_max"),
        F.avg(imp).alias("imp_avg"),
        F.count(F.lit(1)).alias("info_num"),
    )


def replay_best(ledger: DataFrame, n_features: int, rate: float) -> DataFrame:
    """The first ``max(int(n_features * rate), 1)`` key schemes of the best trial."""
    return key_schemes(ledger).orderBy("rank").limit(max(int(n_features * rate), 1))


def path_targets(paths: DataFrame, trials: DataFrame) -> DataFrame:
    """Split-order sequences with their gain over the first trial's validation score."""
    base = trials.orderBy("trial").limit(1).select("valid").scalar()
    return paths.join(trials.select("trial", "valid"), "trial").withColumn("gain", F.col("valid") - base)
