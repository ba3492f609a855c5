import dataclasses
import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from featspan.config import ALL_RULE, PART_RULE, SHIPPED_RANGES, TS_RULE, Feature, Layout, SearchConfig, TaskConfig
from featspan.operators import learn, metrics as m, sampling, trees
from featspan.operators.ingest import slice_tables
from featspan.operators.rownum import global_row_number
from featspan.plans.evaluate import evaluate, features_of, outcome_nodes, prepare, train_matrix
from featspan.plans.search import best_scheme, search_guided, search_random
from featspan.session import materialise, work_dir
from featspan.sources.ledger import FIELDS, Ledger

LAYOUT = Layout(tie=("k",))


@pytest.fixture(scope="module")
def task(spark):
    """Users whose recent f1 is high are positive; f2 is noise."""
    rnd = random.Random(5)
    start, log, labels = date(2024, 1, 1), [], []
    k = 0
    for user in range(240):
        label = user % 2
        for _ in range(rnd.randrange(3, 12)):
            k += 1
            log.append((user, start + timedelta(days=rnd.randrange(100)), 5.0 * label + rnd.random(), rnd.random(), k))
        labels.append((user, start, start + timedelta(days=99), label))
    log_df = spark.createDataFrame(log, "ID long, timestep date, f1 double, f2 double, k long")
    inst = spark.createDataFrame(labels, "ID long, first_timestep date, last_timestep date, label int")
    config = TaskConfig(
        layout=LAYOUT, train_rows=(1, 160), test_rows=(161, 240), train_days=(start, date(2024, 12, 31)),
        test_days=(start, date(2024, 12, 31)), horizon=40, boost_rounds=2, depth=2,
    )
    data = prepare(global_row_number(inst, ("ID",)), log_df, config)
    yield data
    data.close()


SCHEME = [
    Feature("f1", ALL_RULE, "max"), Feature("f2", PART_RULE, "avg", 20), Feature("f1", TS_RULE, "avg", 10),
]


def test_planted_signal_is_found(task, spark):
    outcome = evaluate(task, SCHEME, m.METRICS)
    assert outcome.valid_scores["auc"] > 0.9 and outcome.test_scores["Acc"] > 0.9
    assert outcome.valid == pytest.approx(sum(outcome.valid_scores.values()))
    assert sorted(outcome.columns) == sorted(f.name for f in SCHEME)
    assert evaluate(task, SCHEME, m.METRICS).test_scores == outcome.test_scores
    nodes = outcome_nodes(outcome, spark).persist()
    used = {r["feature"] for r in trees.split_counts(nodes).collect()}
    assert used & {"f1_max", "f1_10ts_avg"}
    assert nodes.where("feature is not null and (left is null or right is null)").isEmpty()


def test_matrix_and_alignment(task):
    matrix, lineage = train_matrix(task, SCHEME, seed=3)
    assert matrix.columns == ["label", "features"] and matrix.count() == 160
    rows = lineage.orderBy("place").collect()
    columns = [r["feature"] for r in rows]
    assert [r["place"] for r in rows] == [0, 1, 2] and [SCHEME[r["position"]].name for r in rows] == columns
    assert all(Feature.of(r).name == r["feature"] for r in rows)
    assert train_matrix(task, [])[1].count() == 0
    table, _ = features_of(task, SCHEME, "test")
    wide = learn.export_matrix(table, ["f1_max", "absent"])
    assert wide.columns == ["label", "f1_max", "absent"] and {r["absent"] for r in wide.collect()} == {0.0}
    assert learn.shuffled(columns, 1) == learn.shuffled(columns, 1)


def test_rounds_do_not_shuffle_the_day_partials(task, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, _ = features_of(task, [f for f in SCHEME if f.rule != TS_RULE])
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_crowded_days_only_are_kept(task):
    rows = task.train.log.groupBy("ID", "timestep").count()
    assert not task.train.days.one_row_per_day and rows.where("count = 1").isEmpty()


def test_other_tasks_fit(task):
    table, lineage = features_of(task, SCHEME)
    names = list(lineage)
    classes = learn.design_matrix(table.withColumn("label", F.col("ID") % 3), names)
    config = TaskConfig(task=m.MULTI, boost_rounds=3, depth=2)
    scored = learn.score(learn.fit(classes, config), classes, m.MULTI)
    assert len(scored.first()["probability"]) == 3
    assert 0 <= m.metrics(scored, ("auc", "F1-score", "Acc"), m.MULTI).first()["score"] <= 3
    amounts = learn.design_matrix(table.withColumn("label", F.col("ID") * 2), names)
    config = TaskConfig(task=m.REGRESSION, boost_rounds=2, depth=2)
    assert learn.score(learn.fit(amounts, config), amounts, m.REGRESSION).count() == 160


@pytest.mark.parametrize("rounds", [10, 11, 40])
def test_all_rounds_are_fitted(task, rounds):
    table, lineage = features_of(task, SCHEME)
    matrix = learn.design_matrix(table, list(lineage), keep=("rand_num",))
    train, valid = matrix.where("rand_num > 0.2").drop("rand_num"), matrix.where("rand_num <= 0.2").drop("rand_num")
    assert learn.fit(train, TaskConfig(boost_rounds=rounds, depth=1), valid).getNumTrees == rounds


def test_patience_cuts_at_the_best_held_out_round(task):
    table, lineage = features_of(task, SCHEME)
    matrix = learn.design_matrix(table, list(lineage), keep=("rand_num",))
    train, valid = matrix.where("rand_num > 0.2").drop("rand_num"), matrix.where("rand_num <= 0.2").drop("rand_num")
    whole = learn.fit(train, TaskConfig(boost_rounds=12, depth=3, step=0.5))
    losses = whole.evaluateEachIteration(valid.withColumn("weight", F.lit(1.0)))
    cut = learn.fit(train, TaskConfig(boost_rounds=12, depth=3, step=0.5, patience=12), valid)
    assert cut.getNumTrees == losses.index(min(losses)) + 1


def test_best_round():
    assert learn.best_round([5, 4, 6, 6, 3], 2) == 2
    assert learn.best_round([5, 4, 6, 6, 3], 3) == 5
    assert learn.best_round([1.0], 1) == 1


def test_default_ranges_lose_nothing(spark):
    rows = spark.range(970_950, 970_980).selectExpr("id as ID", "id as row_num", "cast(id as int) as timestep")
    config = TaskConfig()
    for ranges in ((config.train_rows, config.train_days), (config.test_rows, config.test_days)):
        kept, days = slice_tables(rows, rows, *ranges)
        assert kept.count() == days.count() == 30
    assert slice_tables(rows, rows, SHIPPED_RANGES["test_rows"], None)[0].count() == 11


def test_path_steps_are_taken(task, spark, monkeypatch):
    from featspan.plans import search

    ledger = Ledger(spark, f"{work_dir(spark)}/ledger-steps")
    search_random(task, SearchConfig(rounds=1, n_features=3, seed=1), ledger)
    fields = ledger.long().select(*sampling.FIELDS).distinct()
    grown = {}
    monkeypatch.setattr(search.rank, "grow_paths", lambda lifts, draws, paths, seed: grown.setdefault(draws.agg(F.max("step")).first()[0], draws.select(F.lit(1).alias("path"), "step", "feature")))
    for steps in (2, 5):
        search._grow_paths(ledger, fields, search._candidates(task), fields.select("column").distinct(), SearchConfig(path_steps=steps, pool=20), "s")
    assert sorted(grown) == [1, 4] and all(df.groupBy("step").count().where("count = 20").count() == k + 1 for k, df in grown.items())


def test_guided_search_survives_thin_history(task, spark):
    ledger = Ledger(spark, f"{work_dir(spark)}/ledger-thin")
    thin = dataclasses.replace(task, config=dataclasses.replace(task.config, depth=1, boost_rounds=1))
    config = SearchConfig(
        rounds=2, n_features=4, pool=20, path_steps=1, seed=3,
        selectors=("best_scheme_sample", "score_filter", "imp_filter", "tree_path", "pair_path", "random_generation"),
    )
    trials = search_guided(thin, config, ledger).collect()
    assert [len(r["scheme"]) for r in trials] == [4, 4]


def test_random_search(task, spark):
    ledger = Ledger(spark, f"{work_dir(spark)}/ledger-random")
    config = SearchConfig(rounds=2, n_features=4, seed=1)
    trials = search_random(task, config, ledger).orderBy("trial").collect()
    assert [r["trial"] for r in trials] == [0, 1]
    assert all(len({Feature.of(f).name for f in r["scheme"]}) == 4 for r in trials)
    best = best_scheme(ledger.trials(), config)
    assert best["trial"] in (0, 1) and len(best["scheme"]) == 4
    nothing = search_random(task, dataclasses.replace(config, rounds=5, time_limit=0.0), Ledger(spark, ledger.path))
    assert nothing.count() == 2
    with pytest.raises(ValueError, match="another search"):
        search_random(task, dataclasses.replace(config, n_features=2), ledger)


def files_under(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def test_guided_search_goes_on_where_it_stopped(task, spark):
    ledger = Ledger(spark, f"{work_dir(spark)}/ledger-guided")
    config = SearchConfig(
        rounds=3, n_features=6, pool=30, path_steps=2, seed=2,
        selectors=("best_scheme_sample", "score_filter", "imp_filter", "tree_path", "pair_path", "random_generation"),
    )
    before = files_under(work_dir(spark))
    trials = search_guided(task, config, ledger).orderBy("trial").collect()
    assert all(f.startswith(ledger.path) for f in files_under(work_dir(spark)) - before)

    cut = Ledger(spark, f"{work_dir(spark)}/ledger-cut")
    search_guided(task, dataclasses.replace(config, rounds=2), cut)
    # the third trial got as far as its nodes, and a later one was left over from somewhere
    cut.append_nodes(2, ledger.nodes().where("trial = 0").drop("trial"))
    cut.append({**trials[0].asDict(), "trial": 7})
    assert cut.progress()[0] == 2 and cut.nodes().where("trial = 2").isEmpty()
    resumed = search_guided(task, config, cut).orderBy("trial").collect()
    assert [[r[c] for c in FIELDS if c != "seconds"] for r in resumed] == [[r[c] for c in FIELDS if c != "seconds"] for r in trials]
    assert sorted(cut.until(3).nodes().collect()) == sorted(ledger.nodes().collect())
    again = cut.trials().select("trial", "seconds").collect()
    assert search_guided(task, config, cut).count() == 3 and cut.trials().select("trial", "seconds").collect() == again
    assert [r["trial"] for r in trials] == [0, 1, 2]
    for r in trials:
        names = [Feature.of(f).name for f in r["scheme"]]
        assert len(set(names)) == 6 and sorted(r["columns"]) == sorted(names)
        assert {x["feature"] for x in r["splits"]} == set(r["path"]) <= set(names)
    facts = ledger.long()
    assert facts.count() == 18 and facts.where("splits > 0").count() == sum(len(r["splits"]) for r in trials)


def test_the_fit_reads_a_written_matrix(task, spark, monkeypatch):
    from featspan.plans import evaluate as plans

    seen, whole = {}, plans.fit

    def fit(matrix, config, valid=None):
        seen["plan"] = matrix._jdf.queryExecution().executedPlan().toString()
        seen["rows"], seen["held"], seen["files"] = matrix.count(), valid.count(), matrix.inputFiles()
        return whole(matrix, config, valid)

    monkeypatch.setattr(plans, "fit", fit)
    before = files_under(work_dir(spark))
    evaluate(task, SCHEME)
    # every pass of the fit carries this plan: a scan, not the joins and aggregates of the features
    assert "Scan parquet" in seen["plan"] and not any(x in seen["plan"] for x in ("Join", "Aggregate", "Exchange", "InMemoryTableScan"))
    held = task.train.instances.where("rand_num <= 0.2").count()
    assert (seen["rows"], seen["held"]) == (160 - held, held) and 0 < held < 160
    assert seen["files"] and files_under(work_dir(spark)) == before


def test_materialise_uses_the_shared_folder(spark):
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and work_dir(spark) in df.inputFiles()[0]
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
