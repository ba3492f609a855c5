"""Candidate, sampling, trial, tree and search queries."""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featspan.config import ALL_RULE, METHODS, PART_RULE, RULES, TS_RULE, Feature, SearchConfig, TaskConfig
from featspan.operators import catalogue, learn, metrics as m, rank, sampling, trees, trials as t
from featspan.operators.generate import generate, group_by_rule
from featspan.operators.rownum import global_row_number, holdout
from featspan.plans.evaluate import evaluate, prepare, train_matrix
from featspan.plans.search import search_guided, search_random
from featspan.session import materialise, work_dir
from featspan.sources.ledger import Ledger
from registry import views as v
from registry.generation import DIGITS, ORDER_KEY, SCHEME, scheme_sql
from registry.ingest import HASH

QUERIES, ORACLES = {}, {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _orders_instances(label):
    return f"""SELECT c_custkey AS "ID", {label} AS label FROM customer"""


# --- candidates -------------------------------------------------------------

_SPAN = """SELECT c_custkey, coalesce(max(o_orderdate::date) - min(o_orderdate::date), 0)::int AS horizon
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


def _spans(s, sf):
    orders = v.read(s, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("d"))
    spans = orders.groupBy("c_custkey").agg(F.datediff(F.max("d"), F.min("d")).alias("horizon"))
    customers = v.read(s, sf, "customer").select("c_custkey")
    return customers.join(spans, "c_custkey", "left").withColumn("horizon", F.coalesce("horizon", F.lit(0)))


_add(
    "parts_grid",
    lambda s, sf: catalogue.with_grid(_spans(s, sf), "horizon"),
    f"""SELECT c_custkey, horizon, unnest(CASE WHEN horizon < 1000 THEN range(10, horizon + 1, 10)
        ELSE range(100, horizon + 1, 100) END)::int AS parts FROM ({_SPAN})""",
)


def _columns(s, sf):
    columns = v.ledger(s, sf).select("column").distinct()
    return columns.withColumn("n_columns", F.count(F.lit(1)).over(sampling.Window.partitionBy()))  # no more than the log has


def _horizon(s, sf) -> int:
    return _spans(s, sf).agg(F.max("horizon")).first()[0]


def _candidates(s, sf):
    return catalogue.candidates_of(_columns(s, sf), catalogue.parts_grid(_horizon(s, sf)))


def _sized(df):
    """Rules without windows show 0 parts in query results."""
    return df.withColumn("parts", F.coalesce("parts", F.lit(0)))


def _rule_rows(rule):
    methods = ", ".join(f"'{x}'" for x in METHODS[rule])
    n = len(METHODS[rule])
    if rule == ALL_RULE:
        return f"""SELECT "column", '{rule}' AS rule, method, NULL::int AS parts, "column" || '_' || method AS feature,
          1.0::double / (n_columns * 3 * {n}) AS weight, n_columns
        FROM cols, (SELECT unnest([{methods}]) AS method)"""
    suffix = "p" if rule == PART_RULE else "ts"
    return f"""SELECT "column", '{rule}', method, parts, "column" || '_' || parts || '{suffix}_' || method,
          1.0::double / (n_columns * 3 * {n} * n_grid), n_columns
        FROM cols, grid, (SELECT unnest([{methods}]) AS method), (SELECT count(*) AS n_grid FROM grid)"""


_CANDIDATES = f"""
  WITH cols AS (SELECT "column", count(*) OVER () AS n_columns FROM (SELECT DISTINCT "column" FROM ({v.LEDGER}))),
  horizon AS (SELECT max(horizon) AS h FROM ({_SPAN})),
  grid AS (SELECT unnest(CASE WHEN h < 1000 THEN range(10, h + 1, 10) ELSE range(100, h + 1, 100) END)::int AS parts FROM horizon)
  {' UNION ALL '.join(_rule_rows(r) for r in RULES)}"""

_add(
    "candidates",
    lambda s, sf: _sized(_candidates(s, sf)).withColumn("weight", F.round("weight", 12)).drop("n_columns"),
    f"""SELECT "column", rule, method, coalesce(parts, 0) AS parts, feature, round(weight, 12) AS weight FROM ({_CANDIDATES})""",
)
_add(
    "rule_catalogue",
    lambda s, sf: catalogue.rule_catalogue(s, catalogue.parts_grid(_horizon(s, sf))).select(
        "rule", F.explode("methods").alias("method"), F.coalesce(F.size("parts"), F.lit(0)).alias("sizes"), "pattern"
    ),
    f"""SELECT rule, method, CASE WHEN rule = '{ALL_RULE}' THEN 0 ELSE count(DISTINCT parts) END::int AS sizes,
      CASE WHEN rule = '{ALL_RULE}' THEN '{{feat}}_{{method}}' WHEN rule = '{PART_RULE}' THEN '{{feat}}_{{parts}}p_{{method}}'
           ELSE '{{feat}}_{{parts}}ts_{{method}}' END AS pattern
    FROM ({_CANDIDATES}) GROUP BY rule, method""",
)


def _books(s, sf):
    names = [r["column"] for r in _columns(s, sf).collect()]  # one row per log column
    return catalogue.code_books(sorted(names), catalogue.parts_grid(_horizon(s, sf)))


_METHOD_ORDER = list(dict.fromkeys(x for r in RULES for x in METHODS[r]))
_RULE_LIST = ", ".join(f"'{r}'" for r in RULES)
_METHOD_LIST = ", ".join(f"'{x}'" for x in _METHOD_ORDER)
_add(
    "encode_scheme",
    lambda s, sf: catalogue.encode(_candidates(s, sf).select("feature", "column", "rule", "method", "parts"), _books(s, sf))
    .drop("column", "rule", "method", "parts"),
    f"""SELECT feature, dense_rank() OVER (ORDER BY "column")::int AS feat_code, 1 AS type_code,
      list_position([{_RULE_LIST}], rule)::int AS rule_code, list_position([{_METHOD_LIST}], method)::int AS meth_code,
      CASE WHEN parts IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY parts) END::int AS day_code, 0 AS friend_code
    FROM ({_CANDIDATES})""",
)


def _scheme_by_rule(s, sf):
    """The drawn scheme of 150 features grouped by the operator that the generator uses."""
    drawn = sampling.sample_uniform(_candidates(s, sf), 150, "u1").orderBy("position").collect()
    grouped = group_by_rule([Feature.of(r) for r in drawn])
    rows = [(rule, f.name, position + 1) for rule, items in grouped.items() for f, position in items]
    return s.createDataFrame(rows, "rule string, feature string, position int")


# --- draws ------------------------------------------------------------------


def _draw_sql(source, n, seed, weight="weight"):
    u = HASH.format(f"feature || '{seed}'")
    key = f"-ln(greatest({u}, 1 / pow(2, 53))) / {weight}"
    return f"""SELECT "column", rule, method, coalesce(parts, 0) AS parts, feature,
        row_number() OVER (ORDER BY d, feature)::int AS position
      FROM (SELECT *, {key} AS d FROM ({source}) WHERE {weight} > 0 ORDER BY d, feature LIMIT {n})"""


_add("sample_uniform", lambda s, sf: _sized(sampling.sample_uniform(_candidates(s, sf), 150, "u1")), _draw_sql(_CANDIDATES, 150, "u1"))

_TRIALS = f"SELECT DISTINCT trial, valid, test FROM ({v.LEDGER})"
_RECORDS = f"""SELECT * FROM (SELECT *, max(valid) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM ({_TRIALS})) WHERE before IS NULL OR valid > before"""
_USED = f"""SELECT *, row_number() OVER (PARTITION BY trial ORDER BY splits DESC, "column")::int AS rank
    FROM ({v.LEDGER}) WHERE splits > 0"""
_KEYS = f"""SELECT "column", splits, rank FROM ({_USED}) WHERE trial = (SELECT max(trial) FROM ({_RECORDS}))"""
_KEY5 = f"""SELECT "column" FROM ({_KEYS}) WHERE rank <= 5"""
_BIASED = f"""SELECT c.*, 0.3 * CASE WHEN k."column" IS NULL THEN 0 ELSE weight * n_columns / 5 END + 0.7 * weight AS w
    FROM ({_CANDIDATES}) c LEFT JOIN ({_KEY5}) k ON c."column" = k."column" """


def _key5(s, sf):
    return t.key_schemes(v.ledger(s, sf)).where("rank <= 5").select("column")


_add(
    "sample_biased",
    lambda s, sf: _sized(sampling.sample_biased(_candidates(s, sf), _key5(s, sf), 150, "b1")),
    _draw_sql(_BIASED, 150, "b1", "w"),
)

# The pool appends, record trial by record trial, used columns that are not in it; with 17 columns it
# never outgrows its cap, so the first occurrence of each column decides.
_POOL = f"""SELECT "column", row_number() OVER (ORDER BY trial, rank)::int AS position FROM (
    SELECT "column", trial, rank, row_number() OVER (PARTITION BY "column" ORDER BY trial) AS nth
    FROM ({_USED}) WHERE trial IN (SELECT trial FROM ({_RECORDS}))) WHERE nth = 1"""
_add("key_pool", lambda s, sf: t.key_pool(v.ledger(s, sf)), _POOL)
_add(
    "sample_replace",
    lambda s, sf: sampling.sample_replace(t.key_pool(v.ledger(s, sf)), 2000, "r1"),
    f"""SELECT draw, "column" FROM (SELECT draw, (floor({HASH.format("draw || '/r1'")} * m) + 1)::int AS position
      FROM (SELECT unnest(range(1, 2001)) AS draw), (SELECT count(*) AS m FROM ({_POOL}))) JOIN ({_POOL}) USING (position)""",
)
_add("replay_best", lambda s, sf: t.replay_best(v.ledger(s, sf), 20, 0.25), f"SELECT * FROM ({_KEYS}) WHERE rank <= 5")
_add("key_schemes", lambda s, sf: t.key_schemes(v.ledger(s, sf)), _KEYS)

_CHOSEN = _draw_sql(_CANDIDATES, 150, "u1")


_add(
    "group_by_rule",
    _scheme_by_rule,
    f"SELECT rule, feature, position FROM ({_CHOSEN})",
)


def _fill(s, sf):
    candidates = _candidates(s, sf)
    return _sized(sampling.random_fill(candidates, sampling.sample_uniform(candidates, 150, "u1"), 50, "f1"))


_add(
    "random_fill",
    _fill,
    _draw_sql(f"SELECT * FROM ({_CANDIDATES}) WHERE feature NOT IN (SELECT feature FROM ({_CHOSEN}))", 50, "f1"),
)
_add(
    "lineage",
    lambda s, sf: _sized(
        sampling.lineage_lookup(
            sampling.sample_uniform(_candidates(s, sf), 150, "u1").select("feature"), _candidates(s, sf)
        )
    ),
    f'SELECT feature, "column", rule, method, parts FROM ({_CHOSEN})',
)


def _history_lists(s, sf):
    ledger = v.ledger(s, sf)
    history = t.feature_history(ledger).withColumnRenamed("column", "feature")
    keys = t.key_schemes(ledger).select(F.col("column").alias("feature"), F.col("rank").alias("position"))
    order = lambda *by: history.select(
        "feature", F.rank().over(sampling.Window.orderBy(*by)).alias("position")
    )
    return [
        keys,
        order(F.round(F.col("score_max") + F.col("score_avg"), 6).desc(), "feature"),
        order(F.round(F.col("imp_max") + F.col("imp_avg"), 6).desc(), "feature"),
    ]


_HISTORY = f"""SELECT "column", greatest(max(score), 0) AS score_max, avg(score) AS score_avg,
      greatest(max(imp), 0) AS imp_max, avg(imp) AS imp_avg, count(*) AS info_num
    FROM (SELECT "column", CASE WHEN splits > 0 THEN valid ELSE 0 END AS score,
                 CASE WHEN splits > 0 THEN splits / 10.0 ELSE -1.0 END::double AS imp FROM ({v.LEDGER})) GROUP BY 1"""
_add(
    "scheme_mix",
    lambda s, sf: sampling.mix(_history_lists(s, sf), [3, 7, 11], 12),
    f"""WITH h AS ({_HISTORY}),
    l1 AS (SELECT "column" AS feature, rank AS pos FROM ({_KEYS})),
    l2 AS (SELECT "column" AS feature, row_number() OVER (ORDER BY round(score_max + score_avg, 6) DESC, "column") AS pos FROM h),
    l3 AS (SELECT "column" AS feature, row_number() OVER (ORDER BY round(imp_max + imp_avg, 6) DESC, "column") AS pos FROM h),
    c1 AS (SELECT feature, row_number() OVER (ORDER BY pos) AS position FROM l1 QUALIFY position <= 3),
    c2 AS (SELECT * FROM c1 UNION ALL SELECT feature, (SELECT count(*) FROM c1) + row_number() OVER (ORDER BY pos) AS position
           FROM l2 WHERE feature NOT IN (SELECT feature FROM c1) QUALIFY position <= 7),
    c3 AS (SELECT * FROM c2 UNION ALL SELECT feature, (SELECT count(*) FROM c2) + row_number() OVER (ORDER BY pos) AS position
           FROM l3 WHERE feature NOT IN (SELECT feature FROM c2) QUALIFY position <= 11)
    SELECT feature, position::int AS position FROM c3""",
)

# --- trials -----------------------------------------------------------------

_TOP = f"SELECT * FROM ({_TRIALS}) ORDER BY valid DESC, trial LIMIT 5"
_add("topk_trials", lambda s, sf: t.top_trials(t.trial_scores(v.ledger(s, sf)), 5), _TOP)
_add(
    "best_trial",
    lambda s, sf: t.best_trial(t.trial_scores(v.ledger(s, sf)), 5),
    f"SELECT * FROM ({_TOP}) ORDER BY test DESC, valid DESC, trial LIMIT 1",
)
_add(
    "ts_override",
    lambda s, sf: t.top_trials(t.ts_override(t.trial_scores(v.ledger(s, sf)), "public_ts_orders"), 5),
    f"SELECT trial, test AS valid, test FROM ({_TRIALS}) ORDER BY test DESC, trial LIMIT 5",
)
_add(
    "record_trials",
    lambda s, sf: t.record_trials(t.trial_scores(v.ledger(s, sf))),
    f"SELECT trial, valid, test FROM ({_RECORDS})",
)


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 12))
    return df


_add(
    "feature_history",
    lambda s, sf: _rounded(t.feature_history(v.ledger(s, sf)), "score_max", "score_avg", "imp_max", "imp_avg"),
    f"""SELECT "column", round(score_max, 12) AS score_max, round(score_avg, 12) AS score_avg,
      round(imp_max, 12) AS imp_max, round(imp_avg, 12) AS imp_avg, info_num FROM ({_HISTORY})""",
)

# --- trees ------------------------------------------------------------------

_COUNTS = f"SELECT feature, count(*) AS splits FROM ({v.NODES}) WHERE feature IS NOT NULL GROUP BY 1"
_add(
    "split_counts",
    lambda s, sf: trees.split_counts(v.nodes(s, sf)),
    f"SELECT *, row_number() OVER (ORDER BY splits DESC, feature)::int AS rank FROM ({_COUNTS})",
)


def _all_features(s, sf):
    return v.read(s, sf, "part").select(F.concat(F.lit("f"), (F.col("p_size") % 23).cast("string")).alias("feature")).distinct()


_add(
    "unused_zero",
    lambda s, sf: trees.with_unused(trees.split_counts(v.nodes(s, sf)), _all_features(s, sf)),
    f"""SELECT feature, coalesce(splits, 0) AS splits FROM (SELECT DISTINCT 'f' || (p_size % 23) AS feature FROM part)
    LEFT JOIN ({_COUNTS}) USING (feature)""",
)
_add(
    "split_order",
    lambda s, sf: trees.split_order(v.nodes(s, sf)),
    f"""SELECT feature, row_number() OVER (ORDER BY pos)::int AS position FROM (
      SELECT feature, min(tree * 1000 + id) AS pos FROM ({v.NODES}) WHERE feature IS NOT NULL GROUP BY 1)""",
)
_PARENTS = f"""WITH nd AS ({v.NODES}) SELECT p.tree, p.id, p.feature AS parent, y.feature AS yes, n.feature AS no FROM nd p
    JOIN nd y ON y.tree = p.tree AND y.id = p.l JOIN nd n ON n.tree = p.tree AND n.id = p.r
    WHERE p.feature IS NOT NULL AND y.feature IS NOT NULL AND n.feature IS NOT NULL"""
_add(
    "split_pairs",
    lambda s, sf: trees.split_pairs(v.nodes(s, sf)),
    f"""SELECT parent, child, count(*) AS times FROM (
      SELECT parent, unnest([yes, no]) AS child FROM ({_PARENTS})) GROUP BY ALL""",
)
_NAMES = [f"f{i}" for i in range(17)]
_NEG = f"""SELECT parent, child, count(*) AS times FROM (
      SELECT parent, child, row_number() OVER (PARTITION BY tree, id ORDER BY {HASH.format("tree || '|' || id || '|' || child || 'n1'")}, child) AS nth
      FROM ({_PARENTS}), (SELECT unnest([{', '.join(f"'{x}'" for x in _NAMES)}]) AS child)
      WHERE child <> yes AND child <> no) WHERE nth <= 2 GROUP BY ALL"""
_add("negative_pairs", lambda s, sf: trees.negative_pairs(v.nodes(s, sf), _NAMES, 2, "n1"), _NEG)


def _pair_history(s, sf):
    """Each tree of the fixture counts as a trial of its own, scored by the ledger's trial of that number."""
    nodes = v.nodes(s, sf).withColumn("trial", F.col("tree") % 50)
    trials = t.trial_scores(v.ledger(s, sf))
    positive = trees.split_pairs(nodes, by=("trial",))
    negative = trees.negative_pairs(nodes.drop("trial"), _NAMES, 2, "n1")
    return _rounded(trees.pair_history(positive, negative, trials), "score_max", "score_avg")


_add(
    "pair_history",
    _pair_history,
    f"""SELECT parent, child, round(greatest(max(valid), 0), 12) AS score_max,
      round(sum(valid * times) / sum(times), 12) AS score_avg, sum(times)::bigint AS info_num FROM (
        SELECT parent, child, times, valid FROM (
          SELECT trial, parent, child, count(*) AS times FROM (
            SELECT tree % 50 AS trial, parent, unnest([yes, no]) AS child FROM ({_PARENTS})) GROUP BY ALL)
        JOIN ({_TRIALS}) USING (trial)
        UNION ALL SELECT parent, child, times, 0 FROM ({_NEG})) GROUP BY 1, 2""",
)

# --- models and search -------------------------------------------------------
#
# A fitted model has no SQL. Its queries return what must hold whatever the model says: which rows
# there are, that values lie where they must, that trees hang together.



def _task(s, sf, task=m.BINARY, **changes):
    instances = v.inst_orders(s, sf)
    if task == m.MULTI:
        segment = F.dense_rank().over(sampling.Window.orderBy("c_mktsegment")) - 1
        classes = v.read(s, sf, "customer").select("c_mktsegment").distinct().withColumn("label", segment)
        labels = v.read(s, sf, "customer").join(classes, "c_mktsegment").select(F.col("c_custkey").alias("ID"), "label")
        instances = instances.drop("label").join(labels, "ID")
    if task == m.REGRESSION:
        labels = v.read(s, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").cast("int").alias("label"))
        instances = instances.drop("label").join(labels, "ID")
    numbered = global_row_number(instances, ("ID",))
    n = instances.count()
    layout = v.LAYOUT.with_(carry=("label", "rand_num", "row_num"))
    settings = {"horizon": 819, **changes}
    config = TaskConfig(
        task=task, layout=layout, train_rows=(1, n // 2), test_rows=(n // 2 + 1, n),
        **settings,
    )
    return numbered, v.log_orders(s, sf), config


def _fit_score(task):
    def run(s, sf):
        instances, log, config = _task(s, sf, task)
        table, lineage = generate(instances, log, SCHEME, config.layout)
        matrix = materialise(learn.design_matrix(table, list(lineage), keep=("rand_num",)), "matrix")
        train, _ = holdout(matrix)
        model = learn.fit(train.select("label", "features"), config)
        return learn.score(model, matrix, task)

    return run


def _checked(task):
    """Per scored row: its label, whether the prediction is possible, and the sum of its probabilities."""

    def run(s, sf):
        scored = _fit_score(task)(s, sf)
        if task == m.REGRESSION:
            sound, total = ~F.isnan("prediction"), F.lit(0.0)
        else:
            classes = 2 if task == m.BINARY else 5
            sound = F.col("prediction").isin(*[float(i) for i in range(classes)]) & (F.size("probability") == classes)
            total = F.round(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x), 6)
        return scored.select(F.col("label").cast("int").alias("label"), sound.cast("int").alias("sound"), total.alias("total"))

    return run


_SEGMENT = "dense_rank() OVER (ORDER BY c_mktsegment)::int - 1"
for _name, _kind, _label, _total in (
    ("binary", m.BINARY, "(c_acctbal < 0)::int", "1.0"),
    ("multiclass", m.MULTI, _SEGMENT, "1.0"),
    ("regression", m.REGRESSION, "trunc(c_acctbal)::int", "0.0"),
):
    _add(f"fit_score_{_name}", _checked(_kind), f"SELECT label, 1 AS sound, {_total}::double AS total FROM ({_orders_instances(_label)})")


def _fitted_nodes(s, sf):
    instances, log, config = _task(s, sf)
    table, lineage = generate(instances, log, SCHEME, config.layout)
    columns = learn.shuffled(list(lineage), 1)
    model = learn.fit(materialise(learn.design_matrix(table, columns), "matrix"), config)
    nodes = materialise(learn.node_table(model, s, columns), "nodes")
    child = nodes.select("tree", F.col("id").alias("child")).withColumn("there", F.lit(1))
    ends = nodes.select("tree", F.explode(F.array("left", "right")).alias("child")).where("child IS NOT NULL")
    lost = ends.join(child, ["tree", "child"], "left").groupBy("tree").agg(F.sum((F.col("there").isNull()).cast("int")).alias("lost"))
    shape = nodes.groupBy("tree").agg(
        F.min("id").alias("root"),
        (F.countDistinct("id") == F.count(F.lit(1))).cast("int").alias("distinct_ids"),
        F.min(((F.col("feature").isNull()) == (F.col("left").isNull())).cast("int")).alias("leaves_plain"),
        F.min(F.coalesce(F.col("feature").isin(*columns), F.lit(True)).cast("int")).alias("known_features"),
        (F.count("left") * 2 + 1 == F.count(F.lit(1))).cast("int").alias("binary"),
    )
    return shape.join(lost, "tree", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))


_add(
    "tree_nodes",
    _fitted_nodes,
    """SELECT i AS tree, 0 AS root, 1 AS distinct_ids, 1 AS leaves_plain, 1 AS known_features, 1 AS "binary", 0 AS lost
    FROM range(10) r(i)""",
)


def _matrix(s, sf):
    instances, log, config = _task(s, sf)
    table, lineage = generate(instances, log, SCHEME, config.layout)
    names = list(lineage)
    return learn.export_matrix(table, names).select(
        "label", *[(F.round(F.col(f"`{c}`").cast("double"), DIGITS) + F.lit(0.0)).alias(c) for c in names]
    )


_add(
    "design_matrix",
    _matrix,
    f"""SELECT label, {', '.join(f'"{f.name}"::double AS "{f.name}"' for f in SCHEME)}
    FROM ({scheme_sql(SCHEME, v.LOG_ORDERS, v.INST_ORDERS, ORDER_KEY)}) JOIN ({v.INST_ORDERS}) USING ("ID")""",
)


def _evaluate(s, sf):
    instances, log, config = _task(s, sf)
    data = prepare(instances, log, config)
    outcome = evaluate(data, SCHEME, m.METRICS)
    data.close()
    rows = [(k, int(0 <= outcome.valid_scores[k] <= 1), int(0 <= outcome.test_scores[k] <= 1)) for k in m.METRICS]
    whole = int(abs(outcome.valid - sum(outcome.valid_scores.values())) < 1e-9)
    rows.append(("sum", whole, int(abs(outcome.test - sum(outcome.test_scores.values())) < 1e-9)))
    return s.createDataFrame(rows, "metric string, valid_in_range int, test_in_range int")


_add(
    "evaluate_scheme",
    _evaluate,
    "SELECT unnest(['auc', 'F1-score', 'Acc', 'sum']) AS metric, 1 AS valid_in_range, 1 AS test_in_range",
)


def _facts(s, sf):
    """Ledger with full scheme fields: every line item is a split of some feature in some trial.

    Window sizes are the first four of the grid.
    """
    unit = catalogue.parts_grid(_horizon(s, sf))[0]
    line = v.read(s, sf, "lineitem")
    spec = F.col("l_suppkey") % 9
    rule = F.when(spec < 3, ALL_RULE).when(spec < 6, PART_RULE).otherwise(TS_RULE)
    method = F.element_at(F.array(*[F.lit(x) for x in ("min", "max", "avg")]), (spec % 3 + 1).cast("int"))
    parts = F.when(spec >= 3, ((F.col("l_linenumber") % 4 + 1) * unit).cast("int"))
    rows = line.select(
        (F.col("l_orderkey") % 50).cast("int").alias("trial"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 17).cast("string")).alias("column"),
        rule.alias("rule"), method.alias("method"), parts.alias("parts"), "l_linenumber",
    ).withColumn("feature", catalogue.column_name())
    scores = v.ledger(s, sf).select("trial", "valid", "test").distinct()
    used = rows.groupBy("trial", *sampling.FIELDS).agg(F.sum(F.col("l_linenumber") - 1).alias("splits"))
    return used.join(scores, "trial")


WORTH = 6  # digits of expected values that are compared


def _whole_pool(s, sf):
    """All candidates, in draw order."""
    candidates = materialise(_candidates(s, sf), "candidates")
    return sampling.sample_uniform(candidates, candidates.count(), "pool")


def _worth(ranked):
    return ranked.select("feature", (F.round("expected", WORTH) + F.lit(0.0)).alias("expected"))


def _rank(by):
    def run(s, sf):
        facts = _facts(s, sf)
        flat = facts.select("trial", "valid", "test", F.col("feature").alias("column"), "splits")
        fields = facts.select(*sampling.FIELDS).distinct()
        history = t.feature_history(flat).withColumnRenamed("column", "feature").join(fields, "feature")
        return _worth(rank.rank_candidates(history, _whole_pool(s, sf), by))

    return run


_FACTS = f"""SELECT trial, "column", rule, method, parts, valid, splits,
    CASE WHEN rule = '{ALL_RULE}' THEN "column" || '_' || method
         WHEN rule = '{PART_RULE}' THEN "column" || '_' || parts || 'p_' || method
         ELSE "column" || '_' || parts || 'ts_' || method END AS feature
  FROM (SELECT trial, "column", rule, method, parts, sum(l_linenumber - 1) AS splits FROM (
      SELECT l_orderkey % 50 AS trial, 'f' || (l_partkey % 17) AS "column", l_linenumber,
        CASE WHEN l_suppkey % 9 < 3 THEN '{ALL_RULE}' WHEN l_suppkey % 9 < 6 THEN '{PART_RULE}' ELSE '{TS_RULE}' END AS rule,
        ['min', 'max', 'avg'][l_suppkey % 9 % 3 + 1] AS method,
        CASE WHEN l_suppkey % 9 >= 3 THEN (l_linenumber % 4 + 1) * unit END AS parts
      FROM lineitem, (SELECT CASE WHEN max(horizon) < 1000 THEN 10 ELSE 100 END AS unit FROM ({_SPAN}))) GROUP BY ALL) JOIN (SELECT DISTINCT trial, valid, test FROM ({v.LEDGER})) USING (trial)"""
_FACT_HISTORY = f"""SELECT feature, "column", rule, method, parts, greatest(max(score), 0) AS score_max, avg(score) AS score_avg,
      greatest(max(imp), 0) AS imp_max, avg(imp) AS imp_avg, count(*) AS info_num
    FROM (SELECT *, CASE WHEN splits > 0 THEN valid ELSE 0 END AS score,
                 CASE WHEN splits > 0 THEN splits / 10.0 ELSE -1.0 END::double AS imp FROM ({_FACTS})) GROUP BY ALL"""


def _attributes_sql(prefix=""):
    return f""""column" AS {prefix}at_column, rule || '/' || method AS {prefix}at_method,
      rule || '/' || coalesce(length(bin(parts)), 0) AS {prefix}at_band, rule || '/' || coalesce(parts::varchar, 'None') AS {prefix}at_window"""


def _effects_sql(train, pool, stages, targets, value, shrink=1):
    """feature and expected of the rows of ``pool``: effects fitted stage by stage on ``train``, summed over a row's cells."""
    mean = "sum(info_num * {0}) OVER () / sum(info_num) OVER ()".format
    ctes = [f"s0 AS (SELECT *, {', '.join(f'{mean(x)} AS {x}_0, {x} - {mean(x)} AS {x}_r0' for x in targets)} FROM ({train}))"]
    hats, joins = {x: f"coalesce((SELECT any_value({x}_0) FROM s0), 0)" for x in targets}, ""
    for i, cell in enumerate(stages, 1):
        by = ", ".join(cell)
        means = ", ".join(f"sum(info_num * {x}_r{i - 1}) OVER w / (sum(info_num) OVER w + {shrink}) AS {x}_{i}" for x in targets)
        rests = ", ".join(f"{x}_r{i - 1} - {x}_{i} AS {x}_r{i}" for x in targets)
        ctes.append(f"s{i} AS (SELECT *, {rests} FROM (SELECT *, {means} FROM s{i - 1} WINDOW w AS (PARTITION BY {by})))")
        kept = ", ".join(f"any_value({x}_{i}) AS {x}_{i}" for x in targets)
        joins += f" LEFT JOIN (SELECT {by}, {kept} FROM s{len(stages)} GROUP BY {by}) e{i} USING ({by})"
        for x in targets:
            hats[x] += f" + coalesce(e{i}.{x}_{i}, 0)"
    return f"""WITH {', '.join(ctes)}
      SELECT feature, round(round({value.format(**hats)}, {rank.ROUNDING}), {WORTH}) + 0.0 AS expected FROM ({pool}) pool{joins}"""


_FACT_TRAIN = f"SELECT *, {_attributes_sql()} FROM ({_FACT_HISTORY})"
_SINGLE_POOL = f"SELECT feature, {_attributes_sql()} FROM ({_CANDIDATES})"
for _name, _by, _targets, _value in (
    ("rank_score", "score", ("score_max", "score_avg"), "{score_max} + {score_avg}"),
    ("rank_importance", "imp", ("imp_max", "imp_avg"), "{imp_max} + {imp_avg}"),
    ("rank_combined", "both", ("score_avg", "imp_avg"), "({score_avg}) * ({imp_avg}) + {score_avg}"),
):
    _add(_name, _rank(_by), _effects_sql(_FACT_TRAIN, _SINGLE_POOL, rank.SINGLE_STAGES, _targets, _value))


def _rank_pair(s, sf):
    facts = _facts(s, sf)
    fields = facts.select(*sampling.FIELDS).distinct()
    steps = facts.select("trial", "feature", "valid", F.row_number().over(
        sampling.Window.partitionBy("trial").orderBy(F.col("splits").desc(), "feature")).alias("position"))
    follow = steps.select("trial", (F.col("position") - 1).alias("position"), F.col("feature").alias("child"))
    pairs = steps.withColumnRenamed("feature", "parent").join(follow, ["trial", "position"])
    history = pairs.groupBy("parent", "child").agg(F.max("valid").alias("score_max"), F.avg("valid").alias("score_avg"), F.count(F.lit(1)).alias("info_num"))
    flat = facts.select("trial", "valid", "test", F.col("feature").alias("column"), "splits")
    known = t.key_schemes(flat).select(F.col("column").alias("feature"), F.col("rank").alias("position")).join(fields, "feature")
    pool = _whole_pool(s, sf)
    keys = sampling.sample_replace(known, pool.count(), "k")  # a key for every candidate
    return _worth(rank.rank_pairs(history, fields, keys, pool))


_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY trial ORDER BY splits DESC, feature) AS position FROM ({_FACTS})"
_FIELDS = f'SELECT DISTINCT feature, "column", rule, method, parts FROM ({_FACTS})'
_PAIR_TRAIN = f"""SELECT h.*, x.* EXCLUDE (feature), y.* EXCLUDE (feature)
    FROM (SELECT p.feature AS parent, c.feature AS child, max(p.valid) AS score_max, avg(p.valid) AS score_avg, count(*) AS info_num
          FROM ({_NUMBERED}) p JOIN ({_NUMBERED}) c ON c.trial = p.trial AND c.position = p.position + 1 GROUP BY 1, 2) h
    JOIN (SELECT feature, {_attributes_sql("x_")} FROM ({_FIELDS})) x ON x.feature = parent
    JOIN (SELECT feature, {_attributes_sql("y_")} FROM ({_FIELDS})) y ON y.feature = child"""
_PAIR_POOL = f"""SELECT c.*, k.* EXCLUDE (position, draw) FROM
      (SELECT feature, position, {_attributes_sql("y_")} FROM (SELECT * REPLACE (nullif(parts, 0) AS parts) FROM ({_draw_sql(_CANDIDATES, 10**9, "pool")}))) c
    JOIN (SELECT draw, (floor({HASH.format("draw || '/k'")} * (SELECT count(*) FROM ({_NUMBERED}) WHERE splits > 0 AND trial = (SELECT max(trial) FROM ({_RECORDS})))) + 1)::int AS at
          FROM (SELECT unnest(range(1, (SELECT count(*) FROM ({_CANDIDATES})) + 1)) AS draw)) d ON d.draw = c.position
    JOIN (SELECT position, {_attributes_sql("x_")}, 0 AS draw FROM ({_NUMBERED}) WHERE splits > 0 AND trial = (SELECT max(trial) FROM ({_RECORDS}))) k ON k.position = d.at"""
_add("rank_pair", _rank_pair, _effects_sql(_PAIR_TRAIN, _PAIR_POOL, rank.PAIR_STAGES, ("score_max", "score_avg"), "{score_max} + {score_avg}"))


def _paths(s, sf):
    facts = _facts(s, sf)
    order = sampling.Window.partitionBy("trial").orderBy(F.col("splits").desc(), "feature")
    paths = facts.select("trial", *sampling.FIELDS, F.row_number().over(order).alias("position"))
    return t.path_targets(paths, t.trial_scores(facts))


def _rank_path(s, sf):
    return _worth(rank.first_step(rank.step_lifts(_paths(s, sf)), _whole_pool(s, sf)))


_PATH_SQL = f"""WITH facts AS ({_FACTS}),
  first AS (SELECT *, valid - (SELECT arg_min(valid, trial) FROM facts) AS gain FROM facts
    QUALIFY row_number() OVER (PARTITION BY trial ORDER BY splits DESC, feature) = 1),
  by_column AS (SELECT "column", avg(gain) AS a FROM first GROUP BY 1),
  by_method AS (SELECT rule, method, avg(gain) AS b FROM first GROUP BY 1, 2),
  by_parts AS (SELECT rule, coalesce(parts, 0) AS p, avg(gain) AS c FROM first GROUP BY 1, 2)
  SELECT feature, round(round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), {rank.ROUNDING}), {WORTH}) + 0.0 AS expected
  FROM (SELECT *, coalesce(parts, 0) AS p FROM ({_CANDIDATES}))
  LEFT JOIN by_column USING ("column") LEFT JOIN by_method USING (rule, method) LEFT JOIN by_parts USING (rule, p)"""
_add("rank_path", _rank_path, _PATH_SQL)

STEPS, STEP_POOL, PATHS = 3, 1000, 5


def _path_steps(s, sf):
    """What five paths take in three steps, each step from a pool of its own."""
    draws = rank.path_draws(_candidates(s, sf), _key5(s, sf), STEPS, STEP_POOL, "g1")
    return rank.grow_paths(rank.step_lifts(_paths(s, sf)), draws, PATHS, "g1")


def _path_steps_sql():
    def texts(p):
        return f"""{p}"column" AS c, {p}rule || '/' || {p}method AS m, {p}rule || coalesce('/' || nullif({p}parts, 0), '') AS w"""

    def pick(of, step, size):
        return f"floor({HASH.format(f"{of} || '|' || {step} || '/g1'")} * {size})::int + 1"

    ctes = [
        f"facts AS ({_FACTS})",
        f"""walked AS (SELECT trial, position, valid - (SELECT arg_min(valid, trial) FROM facts) AS gain, {texts("")} FROM
            (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY splits DESC, feature) AS position FROM facts))""",
        """gone AS (SELECT *, lag(c, 1, 'None') OVER o AS pc, lag(m, 1, 'None') OVER o AS pm, lag(w, 1, 'None') OVER o AS pw FROM walked
            WINDOW o AS (PARTITION BY trial ORDER BY position))""",
        *[f"lift_{k} AS (SELECT p{k}, {k}, avg(gain) AS l{k} FROM gone GROUP BY 1, 2)" for k in "cmw"],
        "top_0 AS (SELECT 1 AS place, 'None' AS c, 'None' AS m, 'None' AS w, NULL AS feature)",
    ]
    for step in range(STEPS):
        before = f"top_{step}"
        ctes.append(f"draw_{step} AS MATERIALIZED (SELECT feature, position, {texts('')} FROM ({_draw_sql(_BIASED, STEP_POOL, f'g1/path{step}', 'w')}))")
        joins = " ".join(f"LEFT JOIN lift_{k} ON lift_{k}.p{k} = t.{k} AND lift_{k}.{k} = d.{k}" for k in "cmw")
        ctes.append(f"""top_{step + 1} AS MATERIALIZED (SELECT * FROM (
            SELECT row_number() OVER (ORDER BY round(coalesce(lc, 0) + coalesce(lm, 0) + coalesce(lw, 0), 12) DESC, position) AS place, d.c, d.m, d.w, d.feature
            FROM (SELECT *, {pick("position", step - 1, f"(SELECT count(*) FROM {before})")} AS took FROM draw_{step}) d
            JOIN {before} t ON t.place = d.took {joins}) WHERE place <= {rank.TOP})""")
    picks = [
        f"""SELECT path, {step} AS step, feature FROM (SELECT path::int AS path, {pick("path", step, f"(SELECT count(*) FROM top_{step + 1})")} AS place
        FROM (SELECT unnest(range(1, {PATHS + 1})) AS path)) JOIN top_{step + 1} USING (place)"""
        for step in range(STEPS)
    ]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(picks)}"


_add("path_steps", _path_steps, _path_steps_sql())


def _search(call, *rounds):
    """Trials of a search at its shipped sizes, shortened to few rounds: what they hold, not how they score.

    The search is stopped after each of ``rounds`` and goes on from the ledger.
    """

    def run(s, sf):
        instances, log, config = _task(s, sf)
        data = prepare(instances, log, config)
        path = f"{work_dir(s)}/ledger-{uuid.uuid4().hex}"
        for n in rounds:
            found = call(data, SearchConfig(rounds=n, seed=7), Ledger(s, path))
        known = catalogue.candidates_for(s, data.train.log, config.horizon, config.layout).select("feature")
        rows = materialise(found, "found")
        data.close()
        inside = ((F.col("valid") >= 0) & (F.col("valid") <= 1) & (F.col("test") >= 0) & (F.col("test") <= 1)).cast("int")
        items = rows.select("trial", F.explode("columns").alias("feature")).join(known.withColumn("known", F.lit(1)), "feature", "left")
        items = items.groupBy("trial").agg(
            F.count(F.lit(1)).alias("n_features"), F.countDistinct("feature").alias("n_distinct"), F.sum("known").alias("n_known")
        )
        return rows.select("trial", inside.alias("in_range")).join(items, "trial")

    return run


def guided_round(s, sf) -> float:
    """Seconds of one guided round at the shipped sizes, after one random and one guided round; for the bench."""
    instances, log, config = _task(s, sf)
    data = prepare(instances, log, config)
    ledger = Ledger(s, f"{work_dir(s)}/ledger-{uuid.uuid4().hex}")
    search_guided(data, SearchConfig(rounds=2, seed=7), ledger)
    started = time.perf_counter()
    search_guided(data, SearchConfig(rounds=3, seed=7), ledger)
    took = time.perf_counter() - started
    data.close()
    return took


def _trial_rows(n):
    return f"SELECT i AS trial, 1 AS in_range, 10 AS n_features, 10 AS n_distinct, 10 AS n_known FROM range({n}) r(i)"


_add("search_random", _search(search_random, 2), _trial_rows(2))
_add("search_guided", _search(search_guided, 2, 4), _trial_rows(4))


def _train_matrix(s, sf):
    """Per feature its place in the scheme, and the sum of its entry of the vectors."""
    instances, log, config = _task(s, sf)
    data = prepare(instances, log, replace(config, train_rows=None, test_rows=None))
    matrix, lineage = train_matrix(data, SCHEME, seed=5)
    entries = matrix.select(F.posexplode(vector_to_array("features")).alias("place", "value"))
    sums = entries.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("total"))
    out = materialise(lineage.join(sums, "place").select("feature", "position", "n", (F.col("total") + F.lit(0.0)).alias("total")), "sums")
    data.close()
    return out


_add(
    "train_matrix",
    _train_matrix,
    f"""WITH m AS ({scheme_sql(SCHEME, v.LOG_ORDERS, v.INST_ORDERS, ORDER_KEY)})
    {' UNION ALL '.join(f"""SELECT '{f.name}' AS feature, {i} AS position, count(*) AS n, round(sum("{f.name}"), 1) + 0.0 AS total FROM m""" for i, f in enumerate(SCHEME))}""",
)
