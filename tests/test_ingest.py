import random

import pytest
from pyspark.sql import functions as F

from featspan.config import TaskConfig
from featspan.functions.days import int_to_day, left_days, shift_parts
from featspan.functions.scalars import fill_zero, ratio_or_zero, token_count, unit_hash
from featspan.operators import rownum
from featspan.operators.ingest import (
    attach_static,
    build_instances,
    build_log,
    labels_of,
    outer_merge,
    test_tables as cut_test,
    train_tables as cut_train,
)
from featspan.operators.rownum import global_row_number, holdout
from featspan.operators.skew import find_hot_users, heavy_keys
from featspan.session import work_dir
from featspan.sources import readers


def write(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


@pytest.fixture
def raw(spark, tmp_path):
    pay = write(
        tmp_path / "transactions.csv",
        "msno,transaction_date,payment_method_id,payment_plan_days,plan_list_price,actual_amount_paid,is_auto_renew,is_cancel,membership_expire_date",
        [
            "u1,20170101,41,30,149,149,1,0,20170131",
            "u1,20170101,40,7,50,50,0,1,20161231",
            "u2,20170228,38,30,99,,1,0,0",
        ],
    )
    one = write(
        tmp_path / "usage1.csv",
        "msno,date,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs",
        ["u1,20170101,1,2,3,4,5,6,7.5", "u3,20170105,0,0,0,0,9,9,100.25"],
    )
    two = write(
        tmp_path / "usage2.csv",
        "date,msno,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs",
        ["20170201,u1,1,1,1,1,1,1,1.0"],
    )
    who = write(tmp_path / "members.csv", "msno,city,bd,registered_via", ["u1,5,27,3", "u3,,0,9"])
    churn = write(tmp_path / "labels.csv", "msno,is_churn", ["u1,1", "u2,0", "u3,0", "u4,1"])
    return pay, [one, two], who, churn


def test_log_and_instances_from_files(spark, raw):
    pay, usage, who, churn = raw
    usage_df = readers.union_logs(
        [readers.read_table(spark, p, None).select("msno", "date", *[c for c in readers.read_table(spark, p, None).columns if c not in ("msno", "date")]) for p in usage]
    )
    log = build_log(
        readers.read_table(spark, pay, readers.TRANSACTIONS), usage_df, readers.read_table(spark, who, readers.MEMBERS)
    )
    rows = {(r["ID"], r["timestep"], r["f1"]): r for r in log.collect()}
    assert len(rows) == 5
    assert rows["u1", 20170101, 41]["f7"] == 30 and rows["u1", 20170101, 40]["f7"] == -1
    assert rows["u1", 20170101, 41]["f14"] == 7.5 and rows["u1", 20170101, 41]["f16"] == 27
    assert rows["u1", 20170201, 0]["f14"] == 1.0
    assert rows["u2", 20170228, 38]["f4"] == 0 and rows["u2", 20170228, 38]["f7"] == 0
    assert rows["u3", 20170105, 0]["f15"] == 0 and rows["u3", 20170105, 0]["f17"] == 9

    instances = build_instances(labels_of(readers.read_table(spark, churn, readers.LABELS)), log, salt="z")
    got = {r["ID"]: r for r in instances.collect()}
    assert (got["u1"]["first_timestep"], got["u1"]["last_timestep"]) == (20170101, 20170201)
    assert (got["u4"]["first_timestep"], got["u4"]["last_timestep"]) == (0, 0)
    assert sorted(r["row_num"] for r in got.values()) == [1, 2, 3, 4]
    assert instances.orderBy("row_num").collect() == instances.orderBy("rand_num").collect()

    config = TaskConfig(train_rows=(1, 3), test_rows=(4, 4), train_days=(20170101, 20170131), test_days=(20170101, 20171231))
    train, train_log = cut_train(instances, log, config)
    test, test_log = cut_test(instances, log, config)
    assert (train.count(), test.count(), train_log.count(), test_log.count()) == (3, 1, 3, 5)


def test_usage_files_with_one_schema(spark, raw):
    df = readers.read_table(spark, raw[1][:1], readers.USAGE, ["msno", "total_secs"])
    assert df.columns == ["msno", "total_secs"] and df.count() == 2


def test_merge_is_the_full_outer_join(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([(rnd.randrange(5), rnd.randrange(6), i) for i in range(40)], "ID int, timestep int, a int")
    right = spark.createDataFrame([(rnd.randrange(7), rnd.randrange(6), i) for i in range(40)], "ID int, timestep int, b int")
    want = left.join(right, ["ID", "timestep"], "full_outer")
    got = outer_merge(left, right)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize(("hot_left", "hot_right"), [(400, 3), (3, 400), (120, 90), (400, 0), (0, 400), (0, 0)])
def test_merge_spreads_heavy_keys(spark, hot_left, hot_right):
    rnd = random.Random(hot_left)
    side = lambda hot, n: [(1, 1, i) for i in range(hot)] + [(rnd.randrange(40), rnd.randrange(9), 1000 + i) for i in range(n)] + [(None, 1, 5), (2, None, 6)]
    left = spark.createDataFrame(side(hot_left, 200), "ID int, timestep int, a int")
    right = spark.createDataFrame(side(hot_right, 200), "ID int, timestep int, b int").where("ID <> 1 or timestep <> 1 or b < 1000")
    got = outer_merge(left, right, min_rows=50)
    want = left.join(right, ["ID", "timestep"], "full_outer")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    if hot_left == 400 or hot_right == 400:
        assert any(heavy_keys([left, right], ("ID", "timestep"), 50))


def test_merge_reads_and_shuffles_each_side_once(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = [f"{work_dir(spark)}/{side}-{random.random()}" for side in "lr"]
        for p, n in zip(path, (300, 40)):
            spark.range(n).selectExpr("id % 7 as ID", "if(id % 3 = 0, id % 5, 1) as timestep", "id as v").write.parquet(p)
        sides = [spark.read.parquet(p).withColumnRenamed("v", c) for p, c in zip(path, "ab")]
        for rows in (20, 10_000):
            plan = outer_merge(*sides, min_rows=rows)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FileScan") == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_static_attributes_reach_rows_of_hot_users(spark):
    log = spark.createDataFrame([(7 if i % 3 else i, i % 30, i) for i in range(300)], "ID int, timestep int, a int")
    static = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 2)] + [(7, 70)], "ID int, m int")
    hot = find_hot_users(log, ("ID",), min_rows=20)
    assert [r["ID"] for r in hot.collect()] == [7]
    got = attach_static(log, static, hot=hot)
    want = log.join(static, "ID", "left")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, got.select("ID", "a", "m").collect())) == sorted(map(key, want.select("ID", "a", "m").collect()))
    assert find_hot_users(log, ("ID",)) is None


def test_row_numbers_cover_repeats(spark, monkeypatch):
    monkeypatch.setattr(rownum, "RUN", 7)
    df = spark.createDataFrame([("hot",)] * 100 + [(f"u{i}",) for i in range(50)], "ID string")
    got = global_row_number(df, salt="q")
    assert sorted(r["row_num"] for r in got.collect()) == list(range(1, 151))
    hot = sorted(r["row_num"] for r in got.where("ID = 'hot'").collect())
    assert hot == list(range(hot[0], hot[0] + 100))
    again = global_row_number(df.repartition(5), salt="q")
    assert sorted(got.collect()) == sorted(again.collect())
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("users", [1, 3, 5000])
def test_row_numbers_of_coarse_variates_spread_over_slices(spark, monkeypatch, users):
    df = spark.range(100_000).select((F.col("id") % users).alias("ID"), F.xxhash64("id").alias("a"), (F.col("id") % 7).alias("b"))
    want = global_row_number(df, ("ID",), salt="q", slice_rows=10**9)
    slices, cut = [], rownum._fine_slices
    monkeypatch.setattr(rownum, "_fine_slices", lambda *args: slices.append(cut(*args)) or slices[-1])
    got = global_row_number(df.repartition(3), ("ID",), salt="q", slice_rows=1000, buckets=16)
    order = lambda t: t.agg(F.sum(F.xxhash64("ID", "a", "b", "rand_num", "row_num").cast("decimal(38,0)")), F.min("row_num"), F.max("row_num"), F.countDistinct("row_num")).first()
    assert order(got) == order(want) and order(got)[1:] == (1, 100_000, 100_000)
    rows, keys = slices[0]
    assert rows.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 4000
    # rows of one variate follow the hash of the row
    w = rownum.Window.orderBy("row_num")
    some = got.where("row_num <= 20000").withColumn("h", F.xxhash64("ID", "a", "b"))
    assert some.withColumn("before", F.lag(F.struct("rand_num", "h")).over(w)).where("before > struct(rand_num, h)").isEmpty()


def test_split_is_disjoint_stable_and_near_its_share(spark):
    df = spark.range(5000).select(unit_hash("id").alias("rand_num"), "id")
    train, valid = holdout(df)
    assert train.count() + valid.count() == 5000
    assert 900 < valid.count() < 1100


def test_day_arithmetic(spark):
    df = spark.createDataFrame([(20170320, 20170301), (0, 20170301)], "a int, b int")
    got = df.select(
        shift_parts("a", -10).alias("back"),
        shift_parts("a", -3).alias("odd_back"),
        shift_parts("a", 3).alias("odd_on"),
        left_days("a", "b").alias("gap"),
        int_to_day("a").alias("day"),
    ).collect()
    assert (got[0]["back"], got[0]["odd_back"], got[0]["odd_on"], got[0]["gap"]) == (20170223, 20170312, 20170327, 19)
    assert got[1]["day"] is None and got[1]["gap"] is None


def test_scalars(spark):
    df = spark.createDataFrame([("a,b,,c", 1.0, 0.0), (None, None, None)], "s string, a double, b double")
    got = df.select(token_count("s").alias("n"), ratio_or_zero(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(4, 0.0), (0, 0.0)]
    assert fill_zero(df).collect()[1]["s"] is None


def test_building_an_attached_log_runs_no_job(spark):
    log = spark.createDataFrame([(i % 3, i, i) for i in range(30)], "ID int, timestep int, a int")
    static = spark.createDataFrame([(0, 5)], "ID int, m int")
    spark.sparkContext.setJobGroup("building", "attach")
    attach_static(log, static)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("other", "other")
