import random
from datetime import date, timedelta

import pytest

from brute import feature
from featspan.config import ALL_RULE, METHODS, PART_RULE, TS_RULE, Feature, Layout
from featspan.operators import generate as g
from featspan.operators.generate import DayTable, generate, lineage_frame, prepare_days
from featspan.operators.horizon import profile
from featspan.operators.skew import find_hot_users

LAYOUT = Layout(tie=("k",), carry=())
START = date(2024, 1, 1)
PARTS = {PART_RULE: (1, 2, 5, 12), TS_RULE: (1, 3, 7)}


def every_feature(columns=("f1", "f2")):
    out = []
    for c in columns:
        for rule, methods in METHODS.items():
            for m in methods:
                out += [Feature(c, rule, m, p) for p in PARTS.get(rule, (None,))]
    return out


def tables(spark, seed=0, users=6, rows=200, instances=25, span=60, hot=None):
    """Random log with repeated days, negative values and zeros, and several windows per user."""
    rnd = random.Random(seed)
    log = []
    for k in range(rows):
        user = hot if hot is not None and rnd.random() < 0.4 else rnd.randrange(users)
        day = START + timedelta(days=rnd.randrange(span))
        log.append((user, day, k, {"f1": rnd.choice([0, -3, 5, 2.5, -0.25, 100]), "f2": rnd.randrange(-2, 9)}))
    keys = set()
    while len(keys) < instances:
        user = hot if hot is not None and rnd.random() < 0.4 else rnd.randrange(users + 1)
        first = START + timedelta(days=rnd.randrange(span))
        keys.add((user, first, first + timedelta(days=rnd.randrange(40))))
    log_df = spark.createDataFrame(
        [(u, d, float(v["f1"]), int(v["f2"]), k) for u, d, k, v in log], "ID long, timestep date, f1 double, f2 int, k long"
    )
    inst_df = spark.createDataFrame(sorted(keys), "ID long, first_timestep date, last_timestep date")
    return log, sorted(keys), log_df, inst_df


def check(table, keys, rows, scheme, depth, **options):
    got = {(r["ID"], r["first_timestep"], r["last_timestep"]): r for r in table.collect()}
    assert set(got) == set(keys)
    for key in keys:
        for f in scheme:
            want = feature(key, rows, f, depth, **options)
            assert got[key][f.name] == pytest.approx(want, rel=1e-9, abs=1e-9), (key, f)


@pytest.mark.parametrize("mask", ["zero", "null"])
def test_every_feature_against_brute_force(spark, mask):
    rows, keys, log, inst = tables(spark)
    scheme = every_feature()
    table, lineage = generate(inst, log, scheme, LAYOUT, mask=mask)
    check(table, keys, rows, scheme, 7, mask=mask)
    assert list(lineage) == [f.name for rule in METHODS for f in scheme if f.rule == rule]


def test_left_direction_and_odd_parts(spark):
    rows, keys, log, inst = tables(spark, seed=1)
    scheme = [Feature("f1", PART_RULE, m, p) for m in METHODS[PART_RULE] for p in (1, 3, 5, 9)]
    table, _ = generate(inst, log, scheme, LAYOUT, direction="left")
    check(table, keys, rows, scheme, 0, direction="left")
    table, _ = generate(inst, log, scheme, LAYOUT, days_per_part=1.5)
    check(table, keys, rows, scheme, 0, days_per_part=1.5)


def test_deeper_domain(spark):
    rows, keys, log, inst = tables(spark, seed=2)
    scheme = [Feature("f1", TS_RULE, m, p) for m in METHODS[TS_RULE] for p in (2, 5)]
    table, _ = generate(inst, log, scheme, LAYOUT, max_parts=11)
    check(table, keys, rows, scheme, 11)
    with pytest.raises(ValueError):
        generate(inst, log, scheme, LAYOUT, max_parts=4)


def test_hot_user_is_spread_and_exact(spark):
    rows, keys, log, inst = tables(spark, seed=3, rows=400, instances=60, hot=2)
    hot = find_hot_users(inst, ("ID",), min_rows=4)
    assert hot is not None and 2 in [r["ID"] for r in hot.collect()]
    scheme = every_feature(("f1",))
    table, _ = generate(inst, log, scheme, LAYOUT, hot=hot)
    check(table, keys, rows, scheme, 7)


def test_windows_beyond_the_pushed_row_limit(spark):
    spark.conf.set(g.PUSHED_LIMIT, "2")
    try:
        rows, keys, log, inst = tables(spark, seed=4, span=8)
        scheme = [Feature("f1", TS_RULE, m, p) for m in ("sum", "std", "max_min", "avg_day") for p in (2, 6)]
        table, _ = generate(inst, log, scheme, LAYOUT)
        check(table, keys, rows, scheme, 6)
    finally:
        spark.conf.unset(g.PUSHED_LIMIT)


def test_prepared_days_give_the_same(spark):
    rows, keys, log, inst = tables(spark, seed=5)
    scheme = every_feature(("f2",))
    days = prepare_days(log, ["f1", "f2"], LAYOUT)
    table, _ = generate(inst, log, scheme, LAYOUT, days=days)
    check(table, keys, rows, scheme, 7)
    single = log.dropDuplicates(["ID", "timestep"])
    alone = DayTable(prepare_days(single, ["f1", "f2"], LAYOUT).frame, ("f1", "f2"), one_row_per_day=True)
    one, _ = generate(inst, single, scheme, LAYOUT, days=alone)
    two, _ = generate(inst, single, scheme, LAYOUT)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_logs_with_one_row_per_day_need_no_reduction(spark):
    rows, keys, log, inst = tables(spark, seed=11, rows=300, hot=1)
    kept = {}
    for r in rows:
        kept[r[0], r[1]] = r
    rows = list(kept.values())
    single = log.join(spark.createDataFrame([(r[2],) for r in rows], "k long"), "k")
    layout, scheme = LAYOUT.with_(one_row_per_day=True), every_feature(("f1", "f2"))
    hot = find_hot_users(inst, ("ID",), min_rows=3)
    for options in ({}, {"hot": hot}, {"mask": "null"}):
        table, _ = generate(inst, single, scheme, layout, **options)
        check(table, keys, rows, scheme, 7, mask=options.get("mask", "zero"))
    days = DayTable(prepare_days(single, ["f1", "f2"], LAYOUT).frame, ("f1", "f2"), one_row_per_day=True)
    table, _ = generate(inst, single, scheme, LAYOUT, days=days)
    check(table, keys, rows, scheme, 7)
    long = profile(inst, single, ["f1"], [1, 3, 7], layout, rule=TS_RULE)
    wide, _ = generate(inst, single, [Feature("f1", TS_RULE, "std", p) for p in (1, 3, 7)], layout)
    want = {(r["ID"], r["first_timestep"], r["last_timestep"]): r for r in wide.collect()}
    for r in long.collect():
        cell = want[r["ID"], r["first_timestep"], r["last_timestep"]][f"f1_{r['parts']}ts_std"]
        assert r["f1_std"] == pytest.approx(cell, abs=1e-9)


def test_default_tie_break_is_total(spark):
    _, _, log, inst = tables(spark, seed=6, span=5)
    scheme = [Feature("f1", TS_RULE, m, 3) for m in METHODS[TS_RULE]]
    loose = LAYOUT.with_(tie=())
    first = generate(inst, log.drop("k"), scheme, loose)[0].collect()
    second = generate(inst, log.drop("k").repartition(7), scheme, loose)[0].collect()
    assert sorted(first) == sorted(second)


def test_integer_days_equal_dates(spark):
    rows, keys, log, inst = tables(spark, seed=7)
    scheme = every_feature(("f1",))[:20]
    as_int = "cast(date_format({0}, 'yyyyMMdd') as int) as {0}"
    log_int = log.selectExpr("ID", as_int.format("timestep"), "f1", "f2", "k")
    inst_int = inst.selectExpr("ID", as_int.format("first_timestep"), as_int.format("last_timestep"))
    names = [f.name for f in scheme]
    got = generate(inst_int, log_int, scheme, LAYOUT)[0].select("ID", *names).collect()
    want = generate(inst, log, scheme, LAYOUT)[0].select("ID", *names).collect()
    assert sorted(got) == sorted(want)


def test_without_first_column(spark):
    rows, keys, log, inst = tables(spark, seed=8)
    layout = LAYOUT.with_(first=None)
    last_only = inst.select("ID", "last_timestep").distinct()
    scheme = [Feature("f1", PART_RULE, "avg", 3), Feature("f1", TS_RULE, "avg", 4)]
    got = {(r["ID"], r["last_timestep"]): r for r in generate(last_only, log, scheme, layout, direction="left")[0].collect()}
    for user, _, last in keys:
        for f in scheme:
            want = feature((user, None, last), rows, f, 4, direction="left")
            assert got[user, last][f.name] == pytest.approx(want)
    with pytest.raises(ValueError):
        generate(last_only, log, [Feature("f1", ALL_RULE, "min")], layout)


def small(spark, rows, instances):
    log = spark.createDataFrame(rows, "ID string, timestep date, f1 double, k int")
    inst = spark.createDataFrame(instances, "ID string, first_timestep date, last_timestep date, label int")
    return log, inst


def day(n):
    return START + timedelta(days=n)


def one(spark, rows, scheme, first=10, last=20, **options):
    log, inst = small(spark, rows, [("a", day(first), day(last), 1)])
    table, _ = generate(inst, log, scheme, LAYOUT.with_(carry=("label",)), **options)
    return table.first()


def test_no_history_gives_zero_and_keeps_the_label(spark):
    scheme = every_feature(("f1",))
    log, inst = small(spark, [("b", day(1), 1.0, 1)], [("a", day(10), day(20), 7), ("c", None, None, 8)])
    got = generate(inst, log, scheme, LAYOUT.with_(carry=("label",)))[0].collect()
    assert {r["label"] for r in got} == {7, 8}
    assert all(r[f.name] == 0 for r in got for f in scheme)


def test_edges_of_domains_and_masks(spark):
    a, p, t = ALL_RULE, PART_RULE, TS_RULE
    # single row: deviation 0
    assert one(spark, [("a", day(12), 5.0, 1)], [Feature("f1", a, "std")])["f1_std"] == 0
    # zero average does not raise
    assert one(spark, [("a", day(12), 0.0, 1)], [Feature("f1", t, "day_div_avg", 3)])["f1_3ts_day_div_avg"] == 0
    # negatives: a masked-out row lifts the maximum to 0, otherwise the true maximum shows
    scheme = [Feature("f1", a, "max")]
    assert one(spark, [("a", day(12), -5.0, 1)], scheme)["f1_max"] == -5
    assert one(spark, [("a", day(12), -5.0, 1), ("a", day(25), -1.0, 2)], scheme)["f1_max"] == 0
    # after last: counts as zero for 'all', is absent elsewhere
    rows = [("a", day(12), 6.0, 1), ("a", day(25), 9.0, 2)]
    got = one(spark, rows, [Feature("f1", a, "avg"), Feature("f1", p, "avg", 10), Feature("f1", t, "avg", 5)])
    assert (got["f1_avg"], got["f1_10p_avg"], got["f1_5ts_avg"]) == (3, 6, 6)
    # before first: absent from 'all' and 'ts', present in 'part'
    rows = [("a", day(12), 6.0, 1), ("a", day(5), 2.0, 2)]
    got = one(spark, rows, [Feature("f1", a, "avg"), Feature("f1", p, "avg", 10), Feature("f1", t, "avg", 5)])
    assert (got["f1_avg"], got["f1_10p_avg"], got["f1_5ts_avg"]) == (6, 4, 6)
    # exactly at last - parts is out, exactly at first is in (left)
    rows = [("a", day(10), 7.0, 1)]
    assert one(spark, rows, [Feature("f1", p, "sum", 4)])["f1_4p_sum"] == 0
    assert one(spark, rows, [Feature("f1", p, "sum", 4)], direction="left")["f1_4p_sum"] == 7
    # companions widen the domain of the ts rule
    rows = [("a", day(11 + i), 10.0, i) for i in range(5)]
    got = one(spark, rows, [Feature("f1", t, "avg", 2), Feature("f1", t, "avg", 5)])
    assert (got["f1_2ts_avg"], got["f1_5ts_avg"]) == (4, 10)


def test_large_offsets_do_not_cancel(spark):
    rows = [("a", day(11 + i), 16_000_000.0 + i, i) for i in range(4)]
    got = one(spark, rows, [Feature("f1", ALL_RULE, "std")])
    assert got["f1_std"] == pytest.approx(1.2909944487, rel=1e-9)


def test_nulls_and_nan_count_as_zero(spark):
    rows = [("a", day(12), None, 1), ("a", day(13), float("nan"), 2), ("a", day(14), 6.0, 3)]
    got = one(spark, rows, [Feature("f1", ALL_RULE, "avg"), Feature("f1", ALL_RULE, "count")])
    assert (got["f1_avg"], got["f1_count"]) == (2, 1)


def test_std_names_agree_and_duplicates_collapse(spark):
    rows, keys, log, inst = tables(spark, seed=9)
    f, h = Feature("f1", ALL_RULE, "std"), Feature("f1", ALL_RULE, "stddev")
    table, lineage = generate(inst, log, [f, h, f], LAYOUT)
    assert all(r["f1_std"] == r["f1_stddev"] for r in table.collect())
    assert {n: i for n, (_, i) in lineage.items()} == {"f1_std": 0, "f1_stddev": 1}
    frame = lineage_frame(spark, lineage)
    assert frame.where("feature = 'f1_stddev'").first()["position"] == 1


def test_token_lists(spark):
    log = spark.createDataFrame(
        [("a", day(12), "a,b,c,d,e,f"), ("a", day(13), "x,y,z,w"), ("a", day(40), ",".join("q" * 30)), ("a", day(14), None)],
        "ID string, timestep date, s string",
    )
    inst = spark.createDataFrame([("a", day(10), day(20))], "ID string, first_timestep date, last_timestep date")
    table, _ = generate(inst, log, [Feature("s", ALL_RULE, "strmax")], Layout(carry=()))
    assert table.first()["s_strmax"] == 6


def test_bad_features_are_refused():
    for bad in (("f1", "nope", "min", None), ("f1", ALL_RULE, "median", None), ("f1", PART_RULE, "min", None)):
        with pytest.raises(ValueError):
            Feature(*bad)
    assert Feature.of(["f1", PART_RULE, ["min", 10, None]]).name == "f1_10p_min"
    assert Feature("f1", TS_RULE, "avg", 3).as_list() == ["f1", TS_RULE, ["avg", 3, None]]


@pytest.mark.parametrize(
    "rule,grid,direction",
    [
        (PART_RULE, [1, 2, 3, 7, 12], "right"),
        (PART_RULE, [2, 4, 6, 8], "right"),
        (PART_RULE, [1, 3, 8], "left"),
        (TS_RULE, [1, 2, 3, 5, 8], "right"),
        (TS_RULE, [3, 6, 9], "right"),
    ],
)
def test_profile_equals_single_windows(spark, rule, grid, direction):
    _, keys, log, inst = tables(spark, seed=10, rows=300, span=30)
    methods = ("min", "max", "sum", "avg", "std") + (("count",) if rule == PART_RULE else ("max_min", "max_day", "avg_day", "day_div_avg"))
    long = profile(inst, log, ["f1", "f2"], grid, LAYOUT, rule=rule, methods=methods, direction=direction)
    got = {(r["ID"], r["first_timestep"], r["last_timestep"], r["parts"]): r for r in long.collect()}
    assert len(got) == len(keys) * len(grid)
    scheme = [Feature(c, rule, m, p) for c in ("f1", "f2") for m in methods for p in grid]
    wide, _ = generate(inst, log, scheme, LAYOUT, direction=direction)
    for r in wide.collect():
        for f in scheme:
            cell = got[r["ID"], r["first_timestep"], r["last_timestep"], f.parts][f"{f.column}_{f.method}"]
            assert cell == pytest.approx(r[f.name], rel=1e-9, abs=1e-9), (r["ID"], f)


def test_profile_refuses_methods_without_a_form_over_all_sizes(spark):
    _, _, log, inst = tables(spark)
    with pytest.raises(ValueError, match="no profile of stddev, strmax"):
        profile(inst, log, ["f1"], [1, 3], LAYOUT, rule=TS_RULE, methods=("max", "strmax", "stddev"))


def test_profile_of_the_spread(spark):
    _, _, log, inst = tables(spark)
    long = profile(inst, log, ["f1"], [1, 3], LAYOUT, rule=TS_RULE, methods=("max_min", "max", "min"))
    assert long.where("abs(f1_max_min - (f1_max - f1_min)) > 1e-9").isEmpty()
