"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featspan.operators import metrics as m
from registry import views as v

QUERIES, ORACLES = {}, {}


def _add(name, view, call, sql, column="value"):
    QUERIES[name] = lambda s, sf: call(view(s, sf)).select(F.round("value", 9).alias(column))
    ORACLES[name] = sql


_AUC = """(sum(CASE WHEN y THEN below + 0.5 * tied ELSE 0 END)
    / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)))"""
# Every positive row against the negatives below it and level with it.
_PAIRS = """SELECT *, coalesce(sum((NOT y)::int) OVER (PARTITION BY c ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      - sum((NOT y)::int) OVER (PARTITION BY c, p) AS below, sum((NOT y)::int) OVER (PARTITION BY c, p) AS tied"""
_F1 = "coalesce(2.0 * count(*) FILTER (WHERE label = {c} AND pred = {c}) / nullif(count(*) FILTER (WHERE label = {c}) + count(*) FILTER (WHERE pred = {c}), 0), 0)"

_add(
    "auc_binary", v.scores_bin, m.auc_binary,
    f"SELECT round({_AUC}, 9) AS value FROM ({_PAIRS} FROM (SELECT 0 AS c, label = 1 AS y, p FROM ({v.SCORES_BIN})))",
)
_add(
    "auc_macro", v.scores_multi, m.auc_macro,
    f"""SELECT round(avg(a), 9) AS value FROM (SELECT c, {_AUC} AS a FROM ({_PAIRS} FROM (
      SELECT c, label = c AS y, probs[c + 1] AS p FROM ({v.SCORES_MULTI}), (SELECT unnest(range(10)) AS c))) GROUP BY c)""",
)
_add("f1_positive", v.scores_bin, m.f1_positive, f"SELECT round({_F1.format(c=1)}, 9) AS value FROM ({v.SCORES_BIN})")
_add(
    "f1_macro", v.scores_multi, m.f1_macro,
    f"""WITH s AS ({v.SCORES_MULTI}), classes AS (SELECT label AS c FROM s UNION SELECT pred FROM s)
    SELECT round(avg(f), 9) AS value FROM (SELECT c, {_F1.format(c='c')} AS f FROM s, classes GROUP BY c)""",
)
_add(
    "accuracy", v.scores_bin, m.accuracy,
    f"SELECT round(avg((label = pred)::int), 9) AS value FROM ({v.SCORES_BIN})",
)
_add(
    "accuracy_multi", v.scores_multi, m.accuracy,
    f"SELECT round(avg((label = pred)::int), 9) AS value FROM ({v.SCORES_MULTI})",
)


def _sum(s, sf):
    out = m.metrics(v.scores_bin(s, sf), m.METRICS, m.BINARY)
    each = [F.round(F.col("scores")[n], 9).alias(a) for n, a in zip(m.METRICS, ("auc", "f1", "acc"))]
    return out.select(F.round("score", 9).alias("score"), *each)


QUERIES["score_sum"] = _sum
ORACLES["score_sum"] = f"""
WITH s AS ({v.SCORES_BIN}),
a AS (SELECT {_AUC} AS auc FROM ({_PAIRS} FROM (SELECT 0 AS c, label = 1 AS y, p FROM s))),
b AS (SELECT {_F1.format(c=1)} AS f1, avg((label = pred)::int) AS acc FROM s)
SELECT round(auc + f1 + acc, 9) AS score, round(auc, 9) AS auc, round(f1, 9) AS f1, round(acc, 9) AS acc FROM a, b"""



def _mixed(s, sf):
    """Accuracy next to a metric nobody knows, which scores 0 for every label class."""
    out = m.metrics(v.scores_bin(s, sf), ("Acc", "mse"), m.BINARY)
    return out.select(F.round("score", 9).alias("score"), F.round(F.col("scores")["Acc"], 9).alias("acc"), F.col("scores")["mse"].alias("mse"))


QUERIES["score_unknown"] = _mixed
ORACLES["score_unknown"] = f"""
SELECT round(acc + mse, 9) AS score, round(acc, 9) AS acc, mse
FROM (SELECT avg((label = pred)::int) AS acc, 0.0::double AS mse FROM ({v.SCORES_BIN}))"""
