from collections import Counter

import pytest
from pyspark.sql import functions as F

from featspan.config import ALL_RULE, PART_RULE, RULES, TS_RULE, Feature
from featspan.operators import catalogue as c, rank, sampling as s, trees, trials as t

GRID = c.parts_grid(100)
BOOKS = c.code_books(["f1", "f2", "f3"], GRID)


@pytest.fixture
def candidates(spark):
    columns = spark.createDataFrame([(f"f{i}", 3) for i in (1, 2, 3)], "column string, n_columns int")
    return c.candidates_of(columns, GRID)


def test_grid():
    assert c.parts_grid(819) == list(range(10, 811, 10)) and len(c.parts_grid(819)) == 81
    assert c.parts_grid(25) == [10, 20] and c.parts_grid(1000) == list(range(100, 1001, 100))
    with pytest.raises(ValueError):
        c.parts_grid(9)


def test_grid_per_row(spark):
    df = spark.createDataFrame([(5,), (25,), (1250,)], "horizon int")
    got = Counter(r["horizon"] for r in c.with_grid(df, "horizon").collect())
    assert got == {25: 2, 1250: 12}


def test_candidates_and_their_weights(spark, candidates):
    rows = candidates.collect()
    assert len(rows) == 3 * (7 + 6 * 10 + 9 * 10)
    assert sum(r["weight"] for r in rows) == pytest.approx(1)
    assert len({r["feature"] for r in rows}) == len(rows)
    assert all(Feature.of(r).name == r["feature"] for r in rows)
    per_column = 7 + 6 * 81 + 9 * 81
    assert per_column == 1222 and 17 * per_column == 20774


def test_catalogue_and_codes(spark, candidates):
    rules = c.rule_catalogue(spark, GRID).orderBy("rule_order").collect()
    assert [r["rule"] for r in rules] == list(RULES) and rules[0]["parts"] is None
    coded = {r["feature"]: r for r in c.encode(candidates, BOOKS).collect()}
    assert len(coded) == candidates.count()
    one = coded["f2_30ts_max_min"]
    assert [one[f"{k}_code"] for k in ("feat", "type", "rule", "meth", "day", "friend")] == [2, 1, 3, 8, 3, 0]
    assert coded["f1_stddev"]["day_code"] == 0 and coded["f1_stddev"]["meth_code"] == 7


def test_draws_without_repeats(spark, candidates):
    drawn = s.sample_uniform(candidates, 40, 1).collect()
    assert len({r["feature"] for r in drawn}) == 40
    assert sorted(r["position"] for r in drawn) == list(range(1, 41))
    assert drawn != s.sample_uniform(candidates, 40, 2).collect()
    assert s.sample_uniform(candidates, 10_000, 1).count() == candidates.count()


def test_rules_are_drawn_evenly(candidates):
    by_rule = {r["rule"]: r["w"] for r in candidates.groupBy("rule").agg(F.sum("weight").alias("w")).collect()}
    assert all(by_rule[r] == pytest.approx(1 / 3) for r in RULES)
    # One draw per seed over all candidates at once: the smallest key of each seed.
    seeded = candidates.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(600))))
    u = F.greatest(s.unit_hash("feature", "seed"), F.lit(2.0**-53))
    first = seeded.withColumn("k", -F.log(u) / F.col("weight")).groupBy("seed").agg(F.min_by("rule", "k").alias("rule"))
    rules = Counter(r["rule"] for r in first.collect())
    assert all(150 < rules[r] < 250 for r in RULES)


def test_biased_weights(spark, candidates):
    keys = spark.createDataFrame([("f2",)], "column string")
    sums = {r["column"]: r["w"] for r in s.biased_weight(candidates, keys).groupBy("column").agg(F.sum("weight").alias("w")).collect()}
    assert sums["f2"] == pytest.approx(0.3 + 0.7 / 3) and sums["f1"] == pytest.approx(0.7 / 3)
    none = s.biased_weight(candidates, keys.where("false"))
    assert none.agg(F.sum("weight")).first()[0] == pytest.approx(1)


def test_draws_with_repeats(spark, candidates):
    pool = s.sample_uniform(candidates, 5, 3)
    drawn = s.sample_replace(pool, 500, 4).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(1, 501))
    assert all(60 < n < 140 for n in Counter(r["feature"] for r in drawn).values())


def test_fill_and_lineage(spark, candidates):
    chosen = s.sample_uniform(candidates, 20, 5)
    more = s.random_fill(candidates, chosen, 30, 5)
    assert not {r["feature"] for r in more.collect()} & {r["feature"] for r in chosen.collect()}
    back = s.lineage_lookup(chosen.select("feature"), candidates).collect()
    assert all(Feature.of(r).name == r["feature"] for r in back)


def test_mix_tops_up_without_repeats(spark):
    make = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "feature string, position int")
    got = s.mix([make("abcd"), make("bcxy"), make("xabz")], [2, 4, 6], 10).orderBy("position").collect()
    assert [r["feature"] for r in got] == ["a", "b", "c", "x", "z"]
    assert s.budgets(("best_scheme_sample", "imp_filter", "tree_path", "pair_path", "random_generation"), 10) == [2, 4, 6, 8, 10]
    assert s.budgets(("imp_filter", "random_generation"), 1) == [0, 1]


NODES = [
    # tree 0: root f1 with two split children, one of which has a leaf child
    (0, 0, "f1", 1, 4), (0, 1, "f2", 2, 3), (0, 2, None, None, None), (0, 3, "f3", 5, 6), (0, 4, "f1", 7, 8),
    (0, 5, None, None, None), (0, 6, None, None, None), (0, 7, None, None, None), (0, 8, None, None, None),
    (1, 0, "f4", 1, 2), (1, 1, None, None, None), (1, 2, "f2", 3, 4), (1, 3, None, None, None), (1, 4, None, None, None),
]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(NODES, "tree long, id long, feature string, left long, right long")


def test_tree_statistics(spark, nodes):
    counts = {r["feature"]: (r["splits"], r["rank"]) for r in trees.split_counts(nodes).collect()}
    assert counts == {"f1": (2, 1), "f2": (2, 2), "f3": (1, 3), "f4": (1, 4)}
    columns = spark.createDataFrame([(f"f{i}",) for i in range(1, 6)], "feature string")
    filled = {r["feature"]: r["splits"] for r in trees.with_unused(trees.split_counts(nodes), columns).collect()}
    assert filled == {"f1": 2, "f2": 2, "f3": 1, "f4": 1, "f5": 0}
    order = [r["feature"] for r in trees.split_order(nodes).orderBy("position").collect()]
    assert order == ["f1", "f2", "f3", "f4"]
    pairs = {(r["parent"], r["child"]): r["times"] for r in trees.split_pairs(nodes).collect()}
    assert pairs == {("f1", "f2"): 1, ("f1", "f1"): 1}
    negative = trees.negative_pairs(nodes, ["f1", "f2", "f3", "f4", "f5"], 2, 0).collect()
    assert len(negative) == 2 and {r["parent"] for r in negative} == {"f1"}
    assert all(r["child"] in ("f3", "f4", "f5") for r in negative)


def test_pair_history(spark):
    trials_df = spark.createDataFrame([(0, 0.5), (1, 0.7)], "trial int, valid double")
    positive = spark.createDataFrame([(0, "a", "b", 2), (1, "a", "b", 1)], "trial int, parent string, child string, times long")
    negative = spark.createDataFrame([("a", "b", 1), ("a", "c", 3)], "parent string, child string, times long")
    got = {r["child"]: r for r in trees.pair_history(positive, negative, trials_df).collect()}
    assert got["b"]["score_max"] == 0.7 and got["b"]["score_avg"] == pytest.approx(1.7 / 4) and got["b"]["info_num"] == 4
    assert got["c"]["score_max"] == 0 and got["c"]["score_avg"] == 0


LEDGER = [
    (0, 0.5, 0.4, "a", 3), (0, 0.5, 0.4, "b", 0), (0, 0.5, 0.4, "c", 7),
    (1, 0.5, 0.9, "a", 9), (1, 0.5, 0.9, "d", 1),
    (2, 0.8, 0.3, "d", 2), (2, 0.8, 0.3, "a", 2), (2, 0.8, 0.3, "e", 5),
]


@pytest.fixture
def ledger(spark):
    return spark.createDataFrame(LEDGER, "trial int, valid double, test double, column string, splits long")


def test_trial_questions(spark, ledger):
    scores = t.trial_scores(ledger)
    assert [r["trial"] for r in t.top_trials(scores, 2).collect()] == [2, 0]
    assert t.best_trial(scores, 3).first()["trial"] == 1 and t.best_trial(scores, 2).first()["trial"] == 0
    assert t.top_trials(t.ts_override(scores, "public_ts_x"), 1).first()["trial"] == 1
    assert t.ts_override(scores, "public_user_x").collect() == scores.collect()
    assert sorted(r["trial"] for r in t.record_trials(scores).collect()) == [0, 2]
    assert [r["column"] for r in t.key_schemes(ledger).orderBy("rank").collect()] == ["e", "a", "d"]
    assert [r["column"] for r in t.replay_best(ledger, 10, 0.2).orderBy("rank").collect()] == ["e", "a"]
    pool = t.key_pool(ledger).orderBy("position").collect()
    assert [r["column"] for r in pool] == ["c", "a", "e", "d"]


def test_pool_forgets_and_takes_back(spark):
    rows = [(0, 0.1, 0.0, "a", 2), (0, 0.1, 0.0, "b", 1), (1, 0.2, 0.0, "c", 1), (2, 0.3, 0.0, "a", 1)]
    df = spark.createDataFrame(rows, "trial int, valid double, test double, column string, splits long")
    assert [r["column"] for r in t.key_pool(df, cap=2).orderBy("position").collect()] == ["c", "a"]


def test_feature_history(spark, ledger):
    got = {r["column"]: r for r in t.feature_history(ledger).collect()}
    a, b = got["a"], got["b"]
    assert (a["score_max"], a["info_num"], a["imp_max"]) == (0.8, 3, 0.9)
    assert a["score_avg"] == pytest.approx(1.8 / 3) and a["imp_avg"] == pytest.approx((0.3 + 0.9 + 0.2) / 3)
    assert (b["score_max"], b["score_avg"], b["imp_max"], b["imp_avg"]) == (0, 0, 0, -1)


def test_a_good_column_ranks_high(spark, candidates):
    history = candidates.select(
        *s.FIELDS,
        F.when(F.col("column") == "f2", 0.9).otherwise(0.1).alias("score_max"),
        F.when(F.col("column") == "f2", 0.8).otherwise(0.1).alias("score_avg"),
        F.when(F.col("rule") == TS_RULE, 2.0).otherwise(0.1).alias("imp_max"),
        F.when(F.col("rule") == TS_RULE, 1.0).otherwise(0.0).alias("imp_avg"),
    ).where(s.unit_hash("feature") < 0.5)
    pool = s.sample_uniform(candidates, 100, 8)
    by_score = rank.rank_candidates(history, pool, "score").collect()
    assert {r["feature"] for r in by_score} == {r["feature"] for r in pool.collect()}
    assert all(r["column"] == "f2" for r in by_score[:10])
    assert all(r["rule"] == TS_RULE for r in rank.rank_candidates(history, pool, "imp").limit(10).collect())
    both = rank.rank_candidates(history, pool, "both").limit(5).collect()
    assert all(r["column"] == "f2" and r["rule"] == TS_RULE for r in both)


def test_no_history_keeps_the_whole_pool(spark, candidates):
    none = candidates.select(*s.FIELDS).limit(0)
    history = none.withColumns({c: F.lit(0.0) for c in ("score_max", "score_avg", "imp_max", "imp_avg")})
    pool = s.sample_uniform(candidates, 40, 8)
    drawn = [r["feature"] for r in pool.orderBy("position").collect()]
    ranked = rank.rank_candidates(history, pool, "score").collect()
    assert [r["feature"] for r in ranked] == drawn and {r["expected"] for r in ranked} == {0.0}
    pairs = spark.createDataFrame([], "parent string, child string, score_max double, score_avg double")
    keys = s.sample_replace(s.sample_uniform(candidates, 5, 3), 40, 12)
    ranked = rank.rank_pairs(pairs, none, keys, pool).collect()
    assert [r["feature"] for r in ranked] == drawn and {r["expected"] for r in ranked} == {0.0}


def test_good_pairs_and_paths_rank_high(spark, candidates):
    named = candidates.select(*s.FIELDS)
    some = s.sample_uniform(candidates, 60, 9)
    pairs = some.select(F.col("feature").alias("parent"), F.lit(1).alias("j")).join(
        s.sample_uniform(candidates, 60, 10).select(F.col("feature").alias("child"), "column", F.lit(1).alias("j")), "j"
    )
    good = F.col("column") == "f3"
    pairs = pairs.select("parent", "child", F.when(good, 0.9).otherwise(0.0).alias("score_max"), F.when(good, 0.8).otherwise(0.0).alias("score_avg"))
    pool = s.sample_uniform(candidates, 80, 11)
    keys = s.sample_replace(some.select(*s.FIELDS, "position"), 80, 12)
    ranked = rank.rank_pairs(pairs, named, keys, pool).collect()
    assert len(ranked) == 80 and all(r["column"] == "f3" for r in ranked[:8])



def test_what_a_pair_is_worth_depends_on_its_parent(spark):
    """f3 is good only after f1, f4 only after f2; on their own both are worth the same."""
    parts = {"f1": 10, "f2": 20, "f3": 30, "f4": 40, "f5": 50}
    named = spark.createDataFrame([(f, f, PART_RULE, "max", p) for f, p in parts.items()], "feature string, column string, rule string, method string, parts int")
    good = {("f1", "f3"): 0.9, ("f2", "f4"): 0.9, ("f1", "f4"): 0.1, ("f2", "f3"): 0.1, ("f1", "f5"): 0.3, ("f2", "f5"): 0.3}
    pairs = spark.createDataFrame([(*k, x, x, 6) for k, x in good.items()], "parent string, child string, score_max double, score_avg double, info_num long")
    pool = named.where("feature IN ('f3', 'f4', 'f5')").withColumn("position", F.expr("cast(substr(feature, 2) as int) - 2"))
    for parent, best, worst in (("f1", "f3", "f4"), ("f2", "f4", "f3")):
        keys = named.where(F.col("feature") == parent).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3))))
        ranked = {r["feature"]: r["expected"] for r in rank.rank_pairs(pairs, named, keys, pool).collect()}
        assert list(ranked) == [best, "f5", worst]
        assert ranked[best] > 1.3 and ranked[worst] < 0.7


def test_a_column_counts_by_its_method(spark):
    """Neither column nor method is good alone; f1 with max and f2 with min are, and a window close to theirs."""
    rows = [(c, PART_RULE, m, p, float((c == "f1") == (m == "max"))) for c in ("f1", "f2") for m in ("min", "max") for p in (10, 20)]
    history = spark.createDataFrame(rows, "column string, rule string, method string, parts int, score_max double").withColumn("score_avg", F.col("score_max"))
    history = history.withColumn("feature", c.column_name())
    pool = history.select("column", "rule", "method", F.lit(30).alias("parts"), "feature").distinct()
    pool = pool.withColumn("position", F.row_number().over(s.Window.orderBy("feature")))
    ranked = [(r["column"], r["method"]) for r in rank.rank_candidates(history, pool, "score").collect()]
    assert set(ranked[:4]) == {("f1", "max"), ("f2", "min")}


def test_effects_are_shrunken_means(spark):
    from featspan.operators.effects import add_expected, fit_effects

    train = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 2.0)], "p string, q string, y double")
    stages = (("p",), ("p", "q"))
    effects = fit_effects(train, stages, ["y"], shrink=1.0)
    # mean 2; a: (1 - 1) / 3 = 0, b: 0; then ax: 1 / 2, ay: -1 / 2, bx: 0
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "x")], "k int, p string, q string")
    got = {r["k"]: r["y_hat"] for r in add_expected(rows, "k", effects, stages, ["y"]).collect()}
    assert got == {1: 2.5, 2: 1.5, 3: 2.0, 4: 2.0}
    none = fit_effects(train.limit(0), stages, ["y"])
    assert none.count() == 0 and {r["y_hat"] for r in add_expected(rows, "k", none, stages, ["y"]).collect()} == {0.0}


def test_paths_grow_from_what_they_took(spark, candidates):
    steps = [(0, 1, "f1", ALL_RULE, "min", None, 0.0), (1, 1, "f2", PART_RULE, "max", 20, 0.3), (1, 2, "f3", PART_RULE, "max", 20, 0.3)]
    paths = spark.createDataFrame(steps, "trial int, position int, column string, rule string, method string, parts int, gain double")
    lifts = rank.step_lifts(paths)
    first = rank.first_step(lifts, s.sample_uniform(candidates, 80, 11)).limit(3).collect()
    assert all(r["column"] == "f2" for r in first)
    keys = spark.createDataFrame([("f2",)], "column string")
    draws = rank.path_draws(candidates, keys, 4, 60, "s").persist()
    for k in (0, 3):  # the pool of a step is the biased draw of its own
        want = s.sample_biased(candidates, keys, 60, f"s/path{k}").orderBy("position").collect()
        assert [r["feature"] for r in draws.where(F.col("step") == k).orderBy("position").collect()] == [r["feature"] for r in want]
    grown = rank.grow_paths(lifts, draws, 3, "s").collect()

    table = {(r["kind"], r["prev"], r["next"]): r["lift"] for r in lifts.collect()}
    texts = lambda r: (r["column"], f"{r['rule']}/{r['method']}", r["rule"] if r["parts"] is None else f"{r['rule']}/{r['parts']}")
    pick = lambda position, step, n: int(spark.range(1).select(F.floor(s.unit_hash(F.lit(position), F.lit(step), salt="/s") * n)).first()[0])
    before, want = [("None",) * 3], []
    for k in range(4):
        rows = draws.where(F.col("step") == k).collect()
        hashed = {r["p"]: r["i"] for r in spark.range(1, 61).select(F.col("id").cast("int").alias("p"), F.floor(s.unit_hash(F.col("id").cast("int"), F.lit(k - 1), salt="/s") * len(before)).alias("i")).collect()}
        worth = lambda r: -round(sum(table.get((kind, a, b), 0.0) for kind, a, b in zip(("column", "method", "parts"), before[hashed[r["position"]]], texts(r))), 12)
        top = sorted(rows, key=lambda r: (worth(r), r["position"]))[: rank.TOP]
        want += [(p, k, top[pick(p, k, len(top))]["feature"]) for p in (1, 2, 3)]
        before = [texts(r) for r in top]
    assert sorted(tuple(r) for r in grown) == sorted(want)
    assert rank.grow_paths(lifts.limit(0), draws, 3, "s").count() in (0, 12)
