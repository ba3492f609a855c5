"""Ingest queries: merges, spans, days, ranges, fills, row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featspan.functions.days import day_to_int, left_days, shift_parts
from featspan.functions.scalars import diff_or_zero, fill_zero, ratio_or_zero, token_count
from featspan.operators.ingest import (
    attach_static,
    build_instances,
    build_log,
    first_last,
    labels_of,
    outer_merge,
    slice_tables,
)
from featspan.operators.learn import align_columns
from featspan.operators.generate import generate
from featspan.operators.rownum import global_row_number, holdout
from featspan.config import ALL_RULE, Feature, Layout
from featspan.session import materialise, work_dir
from featspan.sources import readers
from featspan.sources.readers import read_table, union_logs
from registry import views as v

QUERIES, ORACLES = {}, {}
DAY = "(year({0}) * 10000 + month({0}) * 100 + day({0}))::int"
HASH = "(('0x' || substr(md5({0}), 1, 13))::bigint / 4503599627370496.0)"


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _int_day(df, name="timestep"):
    return df.withColumn(name, day_to_int(name))


_add(
    "ingest_full_outer",
    lambda s, sf: _activity(s, sf),
    f"""WITH a AS ({v.USAGE_SIDE}), b AS ({v.PAY_SIDE})
    SELECT coalesce(a."ID", b."ID") AS "ID", {DAY.format('coalesce(a.ts, b.ts)')} AS timestep,
      coalesce(u1, 0) AS u1, coalesce(u2, 0) AS u2, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2
    FROM a FULL JOIN b ON a."ID" = b."ID" AND a.ts = b.ts""",
)

_LOG = f"""SELECT coalesce(a."ID", b."ID") AS "ID", coalesce(a.ts, b.ts) AS ts,
      coalesce(u1, 0) AS u1, coalesce(u2, 0) AS u2, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2
    FROM ({v.USAGE_SIDE}) a FULL JOIN ({v.PAY_SIDE}) b ON a."ID" = b."ID" AND a.ts = b.ts"""


def _activity(s, sf):
    return fill_zero(_int_day(outer_merge(v.usage_side(s, sf), v.pay_side(s, sf))))


_add(
    "ingest_static_join",
    lambda s, sf: fill_zero(attach_static(_activity(s, sf), v.members(s, sf))),
    f"""SELECT l."ID", {DAY.format('ts')} AS timestep, u1, u2, p1, p2, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2
    FROM ({_LOG}) l LEFT JOIN ({v.MEMBERS}) m ON l."ID" = m."ID" """,
)
_add(
    "first_last",
    lambda s, sf: first_last(_activity(s, sf)),
    f"""SELECT "ID", min({DAY.format('ts')}) AS first_timestep, max({DAY.format('ts')}) AS last_timestep
    FROM ({_LOG}) GROUP BY 1""",
)


def _instances(s, sf):
    labels = v.read(s, sf, "customer").select(F.col("c_custkey").alias("ID"), (F.col("c_acctbal") < 0).cast("int").alias("label"))
    return build_instances(labels, _activity(s, sf), salt="s1")


_add(
    "label_instances",
    _instances,
    f"""WITH spans AS (SELECT "ID", min({DAY.format('ts')}) AS f, max({DAY.format('ts')}) AS l FROM ({_LOG}) GROUP BY 1),
    t AS (SELECT c_custkey AS "ID", (c_acctbal < 0)::int AS label, coalesce(f, 0) AS first_timestep,
                 coalesce(l, 0) AS last_timestep,
                 {HASH.format("c_custkey || '|' || (c_acctbal < 0)::int || 's1'")} AS rand_num
          FROM customer LEFT JOIN spans ON c_custkey = "ID")
    SELECT *, row_number() OVER (ORDER BY rand_num, "ID") AS row_num FROM t""",
)
_add(
    "range_labels",
    lambda s, sf: slice_tables(_instances(s, sf), _activity(s, sf), (1, 700), (20240105, 20240120))[0].select("ID", "row_num"),
    f"""SELECT * FROM (SELECT c_custkey AS "ID", row_number() OVER (
        ORDER BY {HASH.format("c_custkey || '|' || (c_acctbal < 0)::int || 's1'")}, c_custkey) AS row_num FROM customer)
    WHERE row_num BETWEEN 1 AND 700""",
)
_add(
    "range_days",
    lambda s, sf: slice_tables(_instances(s, sf), _activity(s, sf), (1, 700), (20240105, 20240120))[1],
    f"""SELECT "ID", {DAY.format('ts')} AS timestep, u1, u2, p1, p2 FROM ({_LOG})
    WHERE ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)


def _left_days(s, sf):
    ship = v.read(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.col("l_shipdate").cast("date")).alias("until")
    )
    orders = v.read(s, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("since"))
    return orders.join(ship, "o_orderkey").select(
        "o_orderkey", left_days(day_to_int("until"), day_to_int("since")).alias("left_days")
    )


_add(
    "left_days",
    _left_days,
    """SELECT o_orderkey, (max(l_shipdate::date) - any_value(o_orderdate::date))::int AS left_days
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)


def _union(s, sf):
    """Two readings of the event file and its parts written as CSV and Parquet, read back and put together."""
    events = _int_day(v.log_events(s, sf)).withColumn("part", F.coalesce(F.col("f2") % 3, F.lit(0)))
    folder = f"{work_dir(s)}/logs-{uuid.uuid4().hex}"
    schema = "ID bigint, timestep int, f1 double, f2 int, k bigint"
    names = ["ID", "timestep", "f1", "f2", "k"]
    split = events.select("part", *[F.col(c).cast(t.split()[1]).alias(c) for c, t in zip(names, schema.split(", "), strict=True)])
    split.where("part < 2").write.partitionBy("part").option("header", True).csv(f"{folder}/csv")
    split.where("part = 2").drop("part").write.parquet(f"{folder}/rest.parquet")
    files = [f"{folder}/csv/part={i}" for i in range(2) if not split.where(F.col("part") == i).isEmpty()]
    frames = [read_table(s, files, schema, names)] if files else []
    return union_logs([*frames, read_table(s, f"{folder}/rest.parquet", schema, names)])


_add(
    "union_logs",
    _union,
    f"""SELECT user_id AS "ID", {DAY.format('ts::date')} AS timestep, event_id AS k, value AS f1, length(props)::int AS f2 FROM events""",
)

_PARTS = (-9, -4, -3, -1, 0, 1, 3, 10, 75)
_add(
    "shift_parts",
    lambda s, sf: v.read(s, sf, "orders").select(
        "o_orderkey",
        *[
            shift_parts(day_to_int(F.col("o_orderdate").cast("date")), p).alias(f"shift_{'m' if p < 0 else ''}{abs(p)}")
            for p in _PARTS
        ],
    ),
    "SELECT o_orderkey, "
    + ", ".join(
        f"{DAY.format(f'(o_orderdate::date + floor(2.5 * {p})::int)')} AS shift_{'m' if p < 0 else ''}{abs(p)}" for p in _PARTS
    )
    + " FROM orders",
)


def _align(s, sf):
    table = v.read(s, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("kept"), F.lit(1.0).alias("extra"))
    return align_columns(table, ["kept", "missing"], ["c_custkey"])


_add("align_missing", _align, "SELECT c_custkey, c_acctbal AS kept, 0.0::double AS missing FROM customer")


def _fill(s, sf):
    doc = v.read(s, sf, "documents").select("doc_id", "n_chars", "lang")
    joined = doc.join(v.read(s, sf, "labels"), "doc_id", "left")
    broken = F.when(F.col("n_chars") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    named = F.when(F.col("n_chars") % 2 == 0, F.col("lang"))
    return fill_zero(joined.select("doc_id", "quality", broken.alias("size"), named.alias("lang")))


_add(
    "fill_zero",
    _fill,
    """SELECT doc_id, coalesce(quality, 0) AS quality,
      CASE WHEN n_chars % 3 = 0 THEN 0 ELSE n_chars END::double AS size,
      CASE WHEN n_chars % 2 = 0 THEN lang END AS lang
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
_add(
    "token_count",
    lambda s, sf: v.read(s, sf, "documents").select("doc_id", "source", token_count("text").alias("tokens")),
    "SELECT doc_id, source, len(string_split(text, ','))::int AS tokens FROM documents",
)


def _strmax(s, sf):
    """Document sources as users, their documents as daily log rows, a window that shuts some of them out."""
    log = v.read(s, sf, "documents").select(
        F.col("source").alias("ID"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("timestep"),
        "text",
    )
    instances = log.select("ID").distinct().select(
        "ID",
        F.lit("2024-02-01").cast("date").alias("first_timestep"),
        F.lit("2024-10-01").cast("date").alias("last_timestep"),
    )
    table, _ = generate(instances, log, [Feature("text", ALL_RULE, "strmax")], Layout(carry=()))
    return table.select("ID", "text_strmax")


_add(
    "all_strmax",
    _strmax,
    """SELECT source AS "ID", coalesce(max(CASE WHEN d <= DATE '2024-10-01' AND length(text) >= 10
        THEN len(string_split(text, ',')) ELSE 0 END) FILTER (WHERE d >= DATE '2024-02-01'), 0)::bigint AS text_strmax
    FROM (SELECT source, text, DATE '2024-01-01' + (doc_id % 365)::int AS d FROM documents) GROUP BY 1""",
)


def _arith(s, sf):
    a = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))
    b = F.when(F.col("c_custkey") % 5 != 0, (F.col("c_nationkey") % 4).cast("double"))
    return v.read(s, sf, "customer").select(
        "c_custkey",
        F.round(diff_or_zero(a, b), 6).alias("diff"),
        F.round(ratio_or_zero(a, b), 6).alias("ratio"),
    )


_add(
    "safe_arithmetic",
    _arith,
    """SELECT c_custkey, round(coalesce(a, 0) - coalesce(b, 0), 6) AS diff,
      round(coalesce(coalesce(a, 0) / nullif(coalesce(b, 0.01::double), 0), 0), 6) AS ratio
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a,
                 CASE WHEN c_custkey % 5 <> 0 THEN (c_nationkey % 4)::double END AS b FROM customer)""",
)
_add(
    "global_row_number",
    lambda s, sf: global_row_number(v.read(s, sf, "customer").select("c_custkey"), ("c_custkey",), salt="x"),
    f"""SELECT c_custkey, rand_num, row_number() OVER (ORDER BY rand_num, c_custkey) AS row_num
    FROM (SELECT c_custkey, {HASH.format("c_custkey || 'x'")} AS rand_num FROM customer)""",
)
_add(
    "row_number_repeats",
    lambda s, sf: global_row_number(v.read(s, sf, "events").select("user_id", "event_type"), salt="y").select(
        "user_id", "event_type", "row_num"
    ),
    f"""SELECT user_id, event_type, row_number() OVER (
        ORDER BY {HASH.format("user_id || '|' || event_type || 'y'")}, user_id, event_type) AS row_num FROM events""",
)


def _holdout(s, sf):
    numbered = global_row_number(v.read(s, sf, "customer").select("c_custkey"), ("c_custkey",))
    train, valid = holdout(numbered)
    return train.select("c_custkey", F.lit("train").alias("part")).unionByName(
        valid.select("c_custkey", F.lit("valid").alias("part"))
    )


_add(
    "holdout_split",
    _holdout,
    f"""SELECT c_custkey, CASE WHEN {HASH.format('c_custkey::varchar')} > 0.2 THEN 'train' ELSE 'valid' END AS part
    FROM customer""",
)


# --- raw tables end to end -------------------------------------------------------


def _int(c):
    return F.col(c).cast("int")


def _raw(s, sf):
    """The given tables in the raw schemas, written as files and read back by them."""
    day = day_to_int(F.col("o_orderdate").cast("date"))
    ship = v.read(s, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.col("l_shipdate").cast("date")).alias("until"), F.count(F.lit(1)).cast("int").alias("lines")
    )
    orders = v.read(s, sf, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    user = F.col("o_custkey").cast("string").alias("msno")
    pay = orders.select(
        user, day.alias("transaction_date"), (F.col("o_orderkey") % 7).cast("int").alias("payment_method_id"),
        F.col("lines").alias("payment_plan_days"), (F.col("o_totalprice") / 100).cast("int").alias("plan_list_price"),
        (F.col("o_totalprice") / 200).cast("int").alias("actual_amount_paid"),
        F.length("o_orderpriority").alias("is_auto_renew"), F.length("o_orderstatus").alias("is_cancel"),
        day_to_int("until").alias("membership_expire_date"),
    )
    kinds = [F.sum((F.col("event_type") == k).cast("int")).cast("int") for k in ("view", "click", "purchase")]
    events = v.read(s, sf, "events")
    usage = events.groupBy(F.col("user_id").cast("string").alias("msno"), day_to_int(F.col("ts").cast("date")).alias("date")).agg(
        *[k.alias(n) for k, n in zip(kinds, ("num_25", "num_50", "num_75"), strict=True)],
        F.count(F.lit(1)).cast("int").alias("num_985"), F.max(F.length("props")).alias("num_100"),
        F.countDistinct("event_type").cast("int").alias("num_unq"), F.round(F.sum("value"), 3).alias("total_secs"),
    )
    customers = v.read(s, sf, "customer")
    members = customers.select(
        F.col("c_custkey").cast("string").alias("msno"), _int("c_nationkey").alias("city"),
        F.length("c_mktsegment").alias("bd"), _int("c_acctbal").alias("registered_via"),
    )
    labels = customers.select(F.col("c_custkey").cast("string").alias("msno"), (F.col("c_acctbal") < 0).cast("int").alias("is_churn"))
    folder = f"{work_dir(s)}/raw-{uuid.uuid4().hex}"
    pay.write.option("header", True).csv(f"{folder}/transactions")
    half = F.col("date") % 2
    usage.where(half == 0).write.parquet(f"{folder}/even.parquet")
    usage.where(half == 1).write.parquet(f"{folder}/odd.parquet")
    members.write.option("header", True).csv(f"{folder}/members")
    labels.write.parquet(f"{folder}/labels.parquet")
    return (
        read_table(s, f"{folder}/transactions", readers.TRANSACTIONS),
        read_table(s, [f"{folder}/even.parquet", f"{folder}/odd.parquet"], readers.USAGE),
        read_table(s, f"{folder}/members", readers.MEMBERS),
        read_table(s, f"{folder}/labels.parquet", readers.LABELS),
    )


_PAY_SQL = f"""SELECT o_custkey::varchar AS "ID", {DAY.format('o_orderdate::date')} AS timestep, (o_orderkey % 7)::int AS f1,
    coalesce(lines, 0)::int AS f2, trunc(o_totalprice / 100)::int AS f3, trunc(o_totalprice / 200)::int AS f4,
    length(o_orderpriority)::int AS f5, length(o_orderstatus)::int AS f6, coalesce((until - o_orderdate::date)::int, 0) AS f7
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate::date) AS until, count(*) AS lines FROM lineitem GROUP BY 1)
    ON o_orderkey = l_orderkey"""
_USE_SQL = f"""SELECT user_id::varchar AS "ID", {DAY.format('ts::date')} AS timestep, sum((event_type = 'view')::int)::int AS f8,
    sum((event_type = 'click')::int)::int AS f9, sum((event_type = 'purchase')::int)::int AS f10, count(*)::int AS f11,
    max(length(props))::int AS f12, count(DISTINCT event_type)::int AS f13, round(sum(value), 3) AS f14
  FROM events GROUP BY 1, 2"""
_MEMBER_SQL = """SELECT c_custkey::varchar AS "ID", c_nationkey::int AS f15, length(c_mktsegment)::int AS f16,
    trunc(c_acctbal)::int AS f17 FROM customer"""
_RAW_LOG = f"""SELECT "ID", timestep, {', '.join(f'coalesce(f{i}, 0) AS f{i}' for i in range(1, 18))}
  FROM ({_USE_SQL}) FULL JOIN ({_PAY_SQL}) USING ("ID", timestep) LEFT JOIN ({_MEMBER_SQL}) USING ("ID")"""

_add(
    "read_raw",
    lambda s, sf: _raw(s, sf)[0].select(
        F.col("msno").alias("ID"), F.col("transaction_date").alias("timestep"), F.col("payment_method_id").alias("f1"),
        F.coalesce("payment_plan_days", F.lit(0)).alias("f2"), F.col("plan_list_price").alias("f3"),
        F.col("actual_amount_paid").alias("f4"), F.col("is_auto_renew").alias("f5"), F.col("is_cancel").alias("f6"),
    ),
    f'SELECT "ID", timestep, f1, f2, f3, f4, f5, f6 FROM ({_PAY_SQL})',
)


def _raw_log(s, sf):
    pay, usage, members, _ = _raw(s, sf)
    return build_log(pay, usage, members)


_add("build_log", _raw_log, _RAW_LOG)


def _raw_instances(s, sf):
    pay, usage, members, labels = _raw(s, sf)
    log = materialise(build_log(pay, usage, members), "log")
    return build_instances(labels_of(labels), log, salt="r1")


_add(
    "build_instances",
    _raw_instances,
    f"""WITH spans AS (SELECT "ID", min(timestep) AS f, max(timestep) AS l FROM ({_RAW_LOG}) GROUP BY 1),
    t AS (SELECT c_custkey::varchar AS "ID", (c_acctbal < 0)::int AS label, coalesce(f, 0) AS first_timestep,
                 coalesce(l, 0) AS last_timestep,
                 {HASH.format("c_custkey || '|' || (c_acctbal < 0)::int || 'r1'")} AS rand_num
          FROM customer LEFT JOIN spans ON c_custkey::varchar = "ID")
    SELECT *, row_number() OVER (ORDER BY rand_num, "ID", label) AS row_num FROM t""",
)
