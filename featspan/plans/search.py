"""Search for a feature set: evenly at random, or guided by what earlier trials' trees used."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, Window, functions as F

from featspan.config import Feature, SearchConfig
from featspan.functions.scalars import unit_hash
from featspan.operators import rank, sampling, trees, trials as t
from featspan.operators.catalogue import candidates_for
from featspan.plans.evaluate import Outcome, TaskData, evaluate, outcome_nodes
from featspan.session import scratch
from featspan.sources.ledger import Ledger

PATHS_USED = 5  # fixed value: this many grown paths are read off


def search_random(data: TaskData, config: SearchConfig, ledger: Ledger) -> DataFrame:
    """Every round evaluates evenly drawn features; trials the ledger holds are not run again. Returns its trials."""
    candidates = _candidates(data)

    def draw(i: int, _: Ledger) -> list[Feature]:
        return _features(sampling.sample_uniform(candidates, config.n_features, f"{config.seed}/{i}"))

    return _rounds(data, config, ledger, "random", draw, keep_nodes=False)


def search_guided(data: TaskData, config: SearchConfig, ledger: Ledger) -> DataFrame:
    """After the first random rounds, each selector fills its share of the scheme from the ledger's earlier trials."""
    candidates = _candidates(data)

    def draw(i: int, past: Ledger) -> list[Feature]:
        seed = f"{config.seed}/{i}"
        if i < config.init_rounds:
            return _features(sampling.sample_uniform(candidates, config.n_features, seed))
        return guided_scheme(data, config, past, candidates, seed)

    return _rounds(data, config, ledger, "guided", draw, keep_nodes=True)


def best_scheme(trials: DataFrame, config: SearchConfig, task: str = "") -> dict:
    """The winning trial: of the top k by validation score the best by test score."""
    ranked = t.ts_override(trials, task)
    winner = t.best_trial(ranked, config.top_k).first()
    top = t.top_trials(ranked, config.top_k).select("trial", "valid", "test").collect()
    return {"trial": winner["trial"], "scheme": [Feature.of(r) for r in winner["scheme"]], "columns": winner["columns"], "top": top}


def _candidates(data: TaskData) -> DataFrame:
    spark = data.train.instances.sparkSession
    return candidates_for(spark, data.train.log, data.config.horizon, data.config.layout)


def _features(drawn: DataFrame) -> list[Feature]:
    return [Feature.of(r) for r in drawn.orderBy("position").collect()]


def _rounds(data: TaskData, config: SearchConfig, ledger: Ledger, kind: str, draw, keep_nodes: bool) -> DataFrame:
    """Run the trials the ledger does not hold yet, from the first missing one on.

    A trial depends on the settings and on the trials before it only, so a search that was cut off
    goes on as if it had not been. The time limit counts over all attempts. What a round writes
    apart from its trial is removed with the round.
    """
    spark = data.train.instances.sparkSession
    settings = {**asdict(config), "rounds": None, "time_limit": None, "top_k": None, "kind": kind}
    ledger.claim(json.dumps(settings, sort_keys=True))
    first, spent = ledger.progress()
    started = time.monotonic() - spent
    for i in range(first, config.rounds):
        if time.monotonic() - started >= config.time_limit:
            break
        with scratch(spark, "round"):
            scheme = draw(i, ledger.until(i))
            outcome = evaluate(data, scheme, config.metrics, seed=config.seed + i)
            _record(data, ledger, i, scheme, outcome, time.monotonic() - started, keep_nodes)
    return ledger.until(max(first, config.rounds)).trials()


def _record(
    data: TaskData, ledger: Ledger, i: int, scheme: list[Feature], outcome: Outcome, seconds: float, keep_nodes: bool
) -> None:
    spark = data.train.instances.sparkSession
    splits, path = [], []
    if keep_nodes:
        nodes = outcome_nodes(outcome, spark)
        ledger.append_nodes(i, nodes)
        splits = [(r["feature"], r["splits"]) for r in trees.split_counts(nodes).collect()]
        path = [r["feature"] for r in trees.split_order(nodes).orderBy("position").collect()]
    task = data.config.name
    valid = outcome.test if task.startswith(t.TS_TASK) else outcome.valid
    ledger.append(
        {
            "trial": i,
            "task": task,
            "valid": valid,
            "test": outcome.test,
            "valid_scores": outcome.valid_scores,
            "test_scores": outcome.test_scores,
            "scheme": [(f.column, f.rule, f.method, f.parts) for f in scheme],
            "columns": outcome.columns,
            "splits": splits,
            "path": path,
            "seconds": seconds,
        }
    )


def guided_scheme(
    data: TaskData, config: SearchConfig, ledger: Ledger, candidates: DataFrame, seed: str
) -> list[Feature]:
    """One scheme from the selectors in turn, topped up at random. At most 2 n rows per selector are collected."""
    spark = candidates.sparkSession
    n, selectors = config.n_features, config.selectors
    rate = 1.0 / len(selectors)
    facts = ledger.long().persist()
    fields = facts.select(*sampling.FIELDS).distinct()
    flat = facts.select("trial", "valid", "test", F.col("feature").alias("column"), "splits")
    keys = t.key_schemes(flat).withColumnRenamed("column", "feature").join(fields, "feature").persist()
    key_columns = sampling.key_names(keys)

    def pool(tag: str, size: int) -> DataFrame:
        return sampling.sample_biased(candidates, key_columns, size, f"{seed}/{tag}")

    def head(df: DataFrame, order) -> DataFrame:
        names = [r["feature"] for r in df.orderBy(*order).limit(2 * n).collect()]
        return spark.createDataFrame([(f, i) for i, f in enumerate(names, 1)], "feature string, position int")

    by_value = (F.col("expected").desc(), F.col("position"))
    lists = []
    for name in selectors:
        if name == "best_scheme_sample":
            first = max(int(n * rate), 1)
            chance = spark.range(1).select(unit_hash(F.lit(name), salt=seed)).first()[0]
            if chance <= sampling.REPLAY_SHARE:
                lists.append(head(keys.where(F.col("rank") <= first), ["rank"]))
            else:
                lists.append(head(pool(name, first), ["position"]))
        elif name in ("score_filter", "imp_filter"):
            history = t.feature_history(flat).withColumnRenamed("column", "feature").join(fields, "feature")
            ranked = rank.rank_candidates(history, pool(name, config.pool), name.split("_")[0])
            lists.append(head(ranked, by_value))
        elif name == "tree_path":
            lists.append(head(_grow_paths(ledger, fields, candidates, key_columns, config, seed), ["position"]))
        elif name == "pair_path":
            known = t.key_pool(flat).withColumnRenamed("column", "feature").join(fields, "feature")
            drawn = sampling.sample_replace(known, 10 * config.pool, f"{seed}/keys")
            ranked = rank.rank_pairs(_pair_history(ledger, config, seed), fields, drawn, pool(name, 10 * config.pool))
            lists.append(head(ranked, by_value))
        elif name != "random_generation":
            raise ValueError(f"unknown selector {name!r}")
    scheme: list[Feature] = []
    if lists:
        caps = [c for c, name in zip(sampling.budgets(selectors, n), selectors) if name != "random_generation"]
        mixed = sampling.mix(lists, caps, n)
        chosen = sampling.lineage_lookup(mixed, candidates).orderBy("position").limit(n)
        scheme = [Feature.of(r) for r in chosen.collect()]
    if len(scheme) < n:
        taken = spark.createDataFrame([(f.name,) for f in scheme], "feature string")
        scheme += _features(sampling.random_fill(candidates, taken, n - len(scheme), f"{seed}/fill"))
    keys.unpersist()
    facts.unpersist()
    return scheme


def _pair_history(ledger: Ledger, config: SearchConfig, seed: str) -> DataFrame:
    nodes, trials = ledger.nodes(), ledger.trials()
    positive = trees.split_pairs(nodes, by=("trial",))
    drawn = nodes.join(trials.select("trial", "columns"), "trial")
    negative = trees.negative_pairs(drawn, "columns", config.neg_num, config.seed, by=("trial",))
    return trees.pair_history(positive, negative, trials)


def _grow_paths(ledger: Ledger, fields: DataFrame, candidates: DataFrame, key_columns: list[str], config: SearchConfig, seed: str) -> DataFrame:
    """(feature, position): what the first paths take, read off path by path, each feature once."""
    trials = ledger.trials()
    paths = trials.select("trial", F.posexplode("path").alias("position", "feature")).join(fields, "feature")
    lifts = rank.step_lifts(t.path_targets(paths, trials))
    draws = rank.path_draws(candidates, key_columns, config.path_steps, config.pool, seed)
    grown = rank.grow_paths(lifts, draws, PATHS_USED, seed)
    first = grown.groupBy("feature").agg(F.min(F.struct("path", "step")).alias("at"))
    # no more rows than paths times steps
    return first.select("feature", F.row_number().over(Window.orderBy("at", "feature")).alias("position"))
