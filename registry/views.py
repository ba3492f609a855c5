"""Views over the given tables that stand in for logs, instances, scores, trees and trials.

Every view exists twice: as a DataFrame and as the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featspan.config import Layout

LAYOUT = Layout(tie=("k",), carry=())


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log_orders(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("ID"),
        F.col("o_orderdate").cast("date").alias("timestep"),
        (F.col("o_totalprice") / 1000).alias("f1"),
        F.length("o_orderpriority").alias("f2"),
        F.col("o_orderkey").alias("k"),
    )


LOG_ORDERS = """
  SELECT o_custkey AS "ID", o_orderdate::date AS ts, (o_totalprice / 1000)::float::double AS f1,
         length(o_orderpriority)::double AS f2, o_orderkey AS k
  FROM orders"""


def inst_orders(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.lit("1997-01-01").cast("date").alias("first_timestep"),
        F.date_add(F.lit("1999-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("last_timestep"),
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
    )


INST_ORDERS = """
  SELECT c_custkey AS "ID", DATE '1997-01-01' AS first,
         DATE '1999-01-01' + (c_custkey % 300)::int AS last, (c_acctbal < 0)::int AS label
  FROM customer"""


def log_events(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("ID"),
        F.col("ts").cast("date").alias("timestep"),
        F.col("value").alias("f1"),
        F.length("props").alias("f2"),
        F.col("event_id").alias("k"),
    )


LOG_EVENTS = """
  SELECT user_id AS "ID", ts::date AS ts, value::float::double AS f1, length(props)::double AS f2, event_id AS k
  FROM events"""


def inst_events(spark, sf) -> DataFrame:
    """One instance per user and day of a purchase: many windows per user, as yyyyMMdd integers."""
    day = F.col("ts").cast("date")
    as_int = lambda d: (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")
    return (
        read(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("user_id").alias("ID"),
            as_int(F.date_sub(day, 10)).alias("first_timestep"),
            as_int(day).alias("last_timestep"),
        )
        .distinct()
    )


INST_EVENTS = """
  SELECT DISTINCT user_id AS "ID", ts::date - 10 AS first, ts::date AS last
  FROM events WHERE event_type = 'purchase'"""


def usage_side(spark, sf) -> DataFrame:
    return (
        read(spark, sf, "events")
        .where(F.col("event_type").isin("view", "click"))
        .groupBy(F.col("user_id").alias("ID"), F.col("ts").cast("date").alias("timestep"))
        .agg(F.count(F.lit(1)).alias("u1"), F.round(F.sum("value"), 4).alias("u2"))
    )


USAGE_SIDE = """
  SELECT user_id AS "ID", ts::date AS ts, count(*) AS u1, round(sum(value), 4) AS u2
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"""


def pay_side(spark, sf) -> DataFrame:
    return (
        read(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("ID"), F.col("ts").cast("date").alias("timestep"))
        .agg(F.count(F.lit(1)).alias("p1"), F.round(F.sum("value"), 4).alias("p2"))
    )


PAY_SIDE = """
  SELECT user_id AS "ID", ts::date AS ts, count(*) AS p1, round(sum(value), 4) AS p2
  FROM events WHERE event_type = 'purchase' GROUP BY ALL"""


def members(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("m1"), F.col("c_acctbal").alias("m2")
    )


MEMBERS = """SELECT c_custkey AS "ID", c_nationkey AS m1, c_acctbal AS m2 FROM customer"""


def scores_bin(spark, sf) -> DataFrame:
    """Quality labels against a tied score; the predicted class is the score above a half."""
    p = (F.col("n_chars") % 100) / 100.0
    return (
        read(spark, sf, "labels")
        .join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            F.col("quality").alias("label"),
            (p > 0.5).cast("int").alias("prediction"),
            F.array(1 - p, p).alias("probability"),
        )
    )


SCORES_BIN = """
  SELECT quality AS label, ((n_chars % 100) / 100.0 > 0.5)::int AS pred, (n_chars % 100) / 100.0 AS p
  FROM labels JOIN documents USING (doc_id)"""


def scores_multi(spark, sf) -> DataFrame:
    """Ten classes; a class scores the mean of all embedding values whose place has its last digit."""
    wide = read(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    own = F.array(*[_class_mean(c) for c in range(10)])
    return wide.withColumn("probs", own).select(
        "label",
        (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("prediction"),
        F.col("probs").alias("probability"),
    )


def _class_mean(c: int):
    own = F.filter("v", lambda x, i: i % 10 == c)
    return F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)


SCORES_MULTI = """
  SELECT vec_id, label, probs, list_position(probs, list_max(probs)) - 1 AS pred FROM (
    SELECT vec_id, label, [list_reduce(list_prepend(0.0::double, [v[k] FOR k IN range(c + 1, len(v) + 1, 10)]), lambda a, x: a + x)
                           / len(range(c + 1, len(v) + 1, 10)) FOR c IN range(10)] AS probs
    FROM (SELECT vec_id, label, embedding::double[] AS v FROM embeddings))"""


def ledger(spark, sf) -> DataFrame:
    """Long trial ledger: one row per trial and feature column, with its split count and the trial's scores."""
    line = read(spark, sf, "lineitem")
    trial = (F.col("l_orderkey") % 50).alias("trial")
    scores = line.groupBy(trial).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("valid"), F.round(F.avg("l_tax") * 10, 6).alias("test")
    )
    part = F.col("l_partkey") % 17
    used = line.groupBy(trial, part.alias("slot")).agg(F.sum(F.col("l_linenumber") - 1).alias("splits"))
    used = used.select(
        "trial",
        F.concat(F.lit("f"), F.col("slot").cast("string")).alias("column"),
        F.when((F.col("trial") + F.col("slot")) % 5 == 0, 0).otherwise(F.col("splits")).alias("splits"),
    )
    return used.join(scores, "trial")


LEDGER = """
  SELECT trial, "column", splits, valid, test FROM (
    SELECT l_orderkey % 50 AS trial, 'f' || (l_partkey % 17) AS "column",
           CASE WHEN (l_orderkey % 50 + l_partkey % 17) % 5 = 0 THEN 0
                ELSE sum(l_linenumber - 1)::bigint END AS splits
    FROM lineitem GROUP BY l_orderkey % 50, l_partkey % 17)
  JOIN (
    SELECT l_orderkey % 50 AS trial, round(avg(l_discount) * 10, 6) AS valid, round(avg(l_tax) * 10, 6) AS test
    FROM lineitem GROUP BY 1) USING (trial)"""


def nodes(spark, sf) -> DataFrame:
    """Tree nodes: 127 parts make one complete tree; some inner nodes are cut down to leaves."""
    base = read(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 127).cast("bigint").alias("tree"),
        (F.col("p_partkey") % 127).cast("bigint").alias("id"),
        "p_size",
    )
    last = base.groupBy("tree").agg(F.max("id").alias("top"))
    left, right = 2 * F.col("id") + 1, 2 * F.col("id") + 2
    split = (left <= F.col("top")) & (F.col("p_size") % 5 != 0)
    return base.join(last, "tree").select(
        "tree",
        "id",
        F.when(split, F.concat(F.lit("f"), (F.col("p_size") % 17).cast("string"))).alias("feature"),
        F.when(split, left).alias("left"),
        F.when(split & (right <= F.col("top")), right).alias("right"),
    )


NODES = """
  SELECT tree, id, CASE WHEN split THEN 'f' || (p_size % 17) END AS feature,
         CASE WHEN split THEN 2 * id + 1 END AS l,
         CASE WHEN split AND 2 * id + 2 <= top THEN 2 * id + 2 END AS r
  FROM (SELECT *, 2 * id + 1 <= top AND p_size % 5 <> 0 AS split
        FROM (SELECT *, max(id) OVER (PARTITION BY tree) AS top
              FROM (SELECT p_partkey // 127 AS tree, p_partkey % 127 AS id, p_size FROM part)))"""
