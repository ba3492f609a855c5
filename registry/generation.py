"""Feature generation queries: every rule and method, fused schemes, many windows at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from featspan.config import ALL_RULE, METHODS, PART_RULE, TS_RULE, Feature
from featspan.operators.generate import generate
from featspan.operators.horizon import profile
from registry import views as v

DIGITS = 3


def rounded(df, key):
    cols = []
    for name, kind in df.dtypes:
        if name in key:
            continue
        c = F.col(f"`{name}`")
        cols.append((F.round(c, DIGITS) + F.lit(0.0)).alias(name) if kind == "double" else c)
    return df.select(*key, *cols)


def feature_sql(f: Feature, depth: int, direction: str = "right") -> str:
    """The feature straight from raw rows ``r``: all masked aggregates spelled out."""
    v, method = f.column, f.method
    if f.rule == ALL_RULE:
        domain, hit = "ga", "gb"
    elif f.rule == PART_RULE:
        domain = "gb"
        hit = f"ts > last - {-((-f.parts * 5) // 2)}"
        if direction == "left":
            hit = f"ts >= first AND ts < first + {(f.parts * 5) // 2}"
    else:
        domain, hit = f"ga AND gb AND rn <= {depth}", f"rn <= {f.parts}"
    where = f"FILTER (WHERE {domain})"
    masked = f"CASE WHEN {hit} THEN {v} ELSE 0 END"
    latest = f"coalesce(max(CASE WHEN rn = 1 THEN {v} ELSE 0 END) {where}, 0)"
    if method == "count":
        return f'coalesce(sum(CASE WHEN {hit} AND {v} > 0 THEN 1 ELSE 0 END) {where}, 0)::bigint AS "{f.name}"'
    if method == "max_min":
        e = f"coalesce(max({masked}) {where}, 0) - coalesce(min({masked}) {where}, 0)"
    elif method == "max_day":
        e = f"coalesce(max({masked}) {where}, 0) - {latest}"
    elif method == "avg_day":
        e = f"coalesce(avg({masked}) {where}, 0) - {latest}"
    elif method == "day_div_avg":
        e = f"{latest} / nullif(coalesce(avg({masked}) {where}, 0.01), 0)"
    else:
        e = f"{ {'std': 'stddev_samp', 'stddev': 'stddev_samp'}.get(method, method)}({masked}) {where}"
    return f'round(coalesce({e}, 0), {DIGITS}) + 0.0 AS "{f.name}"'


def scheme_sql(scheme, log, inst, key, depth=None, direction="right") -> str:
    depth = depth or max([f.parts for f in scheme if f.rule == TS_RULE], default=0)
    ordered = [f for rule in (ALL_RULE, PART_RULE, TS_RULE) for f in scheme if f.rule == rule]
    cols = ",\n  ".join(feature_sql(f, depth, direction) for f in ordered)
    return f"""
WITH log AS ({log}), inst AS ({inst}),
j AS (SELECT i.*, l.ts, l.f1, l.f2, l.k, l.ts >= i.first AS ga, l.ts <= i.last AS gb
      FROM inst i LEFT JOIN log l ON i."ID" = l."ID"),
r AS (SELECT *, row_number() OVER (PARTITION BY "ID", first, last, coalesce(ga AND gb, false)
                                   ORDER BY ts DESC, k DESC) AS rn FROM j)
SELECT {key},
  {cols}
FROM r GROUP BY "ID", first, last"""


ORDER_KEY = '"ID"'
EVENT_KEY = '"ID", (year(last) * 10000 + month(last) * 100 + day(last))::int AS last_timestep'

QUERIES, ORACLES = {}, {}


def _orders(name, scheme, direction="right", **options):
    def run(spark, sf):
        table, _ = generate(
            v.inst_orders(spark, sf), v.log_orders(spark, sf), scheme, v.LAYOUT, direction=direction, **options
        )
        return rounded(table, ["ID"]).drop("first_timestep", "last_timestep")

    QUERIES[name] = run
    ORACLES[name] = scheme_sql(
        scheme, v.LOG_ORDERS, v.INST_ORDERS, ORDER_KEY, options.get("max_parts"), direction
    )


def _events(name, scheme, direction="right", **options):
    def run(spark, sf):
        table, _ = generate(
            v.inst_events(spark, sf), v.log_events(spark, sf), scheme, v.LAYOUT, direction=direction, **options
        )
        return rounded(table, ["ID", "last_timestep"]).drop("first_timestep")

    QUERIES[name] = run
    ORACLES[name] = scheme_sql(
        scheme, v.LOG_EVENTS, v.INST_EVENTS, EVENT_KEY, options.get("max_parts"), direction
    )


for _m in METHODS[ALL_RULE]:
    _orders(f"all_{_m}", [Feature("f1", ALL_RULE, _m)])
for _m in METHODS[PART_RULE]:
    _scheme = [Feature("f1", PART_RULE, _m, p) for p in (100, 300)]
    _orders(f"part_right_{_m}", _scheme)
    _orders(f"part_left_{_m}", _scheme, direction="left")
for _m in METHODS[TS_RULE]:
    _orders(f"ts_{_m}", [Feature("f1", TS_RULE, _m, p) for p in (2, 5)])
    _events(f"ts_same_day_{_m}", [Feature("f1", TS_RULE, _m, p) for p in (1, 3, 8)])

SCHEME = [
    Feature("f1", ALL_RULE, "sum"),
    Feature("f1", ALL_RULE, "std"),
    Feature("f2", ALL_RULE, "avg"),
    Feature("f1", PART_RULE, "avg", 150),
    Feature("f1", PART_RULE, "std", 200),
    Feature("f2", PART_RULE, "max", 100),
    Feature("f1", TS_RULE, "day_div_avg", 5),
    Feature("f1", TS_RULE, "max_min", 3),
    Feature("f2", TS_RULE, "std", 5),
    Feature("f2", TS_RULE, "max_day", 2),
]
_orders("scheme_fused", SCHEME)

EVENT_SCHEME = [
    Feature("f1", ALL_RULE, "min"),
    Feature("f1", ALL_RULE, "count"),
    Feature("f1", PART_RULE, "sum", 1),
    Feature("f1", PART_RULE, "avg", 3),
    Feature("f2", PART_RULE, "std", 2),
    Feature("f1", TS_RULE, "avg", 4),
    Feature("f1", TS_RULE, "avg_day", 7),
    Feature("f2", TS_RULE, "std", 5),
    Feature("f1", TS_RULE, "day_div_avg", 10),
]
_events("scheme_many_windows", EVENT_SCHEME)
_events("scheme_left_odd_parts", [f for f in EVENT_SCHEME if f.rule == PART_RULE], direction="left")
_events("scheme_deep_domain", [f for f in EVENT_SCHEME if f.rule == TS_RULE], max_parts=20)


def profile_sql(rule, grid, methods, log, inst, key, direction="right") -> str:
    """Every window size as a scheme of its own."""
    parts = []
    for p in grid:
        scheme = [Feature("f1", rule, m, p) for m in methods]
        names = ", ".join(f'"{f.name}" AS "f1_{f.method}"' for f in scheme)
        body = scheme_sql(scheme, log, inst, key, grid[-1], direction)
        label = '"ID"' if key == ORDER_KEY else '"ID", last_timestep'
        parts.append(f"SELECT {label}, {p} AS parts, {names} FROM ({body})")
    return " UNION ALL ".join(parts)


def _profile(name, rule, grid, methods, events=False, direction="right"):
    def run(spark, sf):
        log, inst = (v.log_events, v.inst_events) if events else (v.log_orders, v.inst_orders)
        table = profile(
            inst(spark, sf), log(spark, sf), ["f1"], grid, v.LAYOUT, rule=rule, methods=methods, direction=direction
        )
        key = ["ID", "last_timestep", "parts"] if events else ["ID", "parts"]
        unused = ["first_timestep"] if events else ["first_timestep", "last_timestep"]
        return rounded(table.drop(*unused), key)

    QUERIES[name] = run
    log, inst = (v.LOG_EVENTS, v.INST_EVENTS) if events else (v.LOG_ORDERS, v.INST_ORDERS)
    ORACLES[name] = profile_sql(rule, grid, methods, log, inst, EVENT_KEY if events else ORDER_KEY, direction)


_ALL_SIX = ("min", "max", "sum", "avg", "std", "count")
_profile("scheme_horizons", PART_RULE, list(range(100, 1001, 100)), _ALL_SIX)
_profile("horizons_left", PART_RULE, [50, 100, 250, 400], _ALL_SIX, direction="left")
_profile("horizons_odd_sizes", PART_RULE, [1, 2, 3, 5, 8], _ALL_SIX, events=True)
_profile("horizons_latest_rows", TS_RULE, [2, 4, 6, 8, 10, 12], _ALL_SIX[:-1], events=True)
_profile("horizons_latest_days", TS_RULE, [1, 2, 4], _ALL_SIX[:-1])
_profile("horizons_latest_value", TS_RULE, [1, 2, 3, 5, 8, 13], ("max_day", "avg_day", "day_div_avg"), events=True)
