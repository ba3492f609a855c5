"""Scheme -> feature table.

The log is first reduced to one row of mergeable partials per user and day, so a user
never weighs more than the number of days it was active. Every feature is then a masked
merge of those partials per instance. Rules differ in which days count at all (the
domain) and which of them keep their value (the mask; the others count as zero):

=====  =======================  ==========================================
rule   domain                   mask
=====  =======================  ==========================================
all    first <= day             day <= last
part   day <= last              last - parts < day   (direction right)
                                first <= day < first + parts   (left)
ts     first <= day <= last,    the latest ``parts`` rows
       latest ``max_parts``
=====  =======================  ==========================================

The ts rule counts rows, not days: whole days come from the partials, and the one day
that a window cuts through comes from running totals within that day, folded to one row per
user and day and looked up by place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from featspan.config import ALL_RULE, PART_RULE, TS_RULE, Feature, Layout
from featspan.functions.days import DAYS_PER_PART, as_day, part_days
from featspan.functions.scalars import as_feature, token_count
from featspan.operators.skew import SALT, find_hot_users, spread

# Fixed value: shorter strings hold no token list worth counting.
MIN_TOKEN_TEXT = 10
# Row limits beyond this setting are not pushed below the shuffle by Spark, so we do it ourselves.
PUSHED_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
DAY_SALTS = 64

# State needed by each method; "lo" and "hi" guard the deviation of constant windows.
NEEDS = {
    "min": ("lo",),
    "max": ("hi",),
    "sum": ("sum",),
    "avg": ("sum",),
    "std": ("sum", "m2", "lo", "hi"),
    "stddev": ("sum", "m2", "lo", "hi"),
    "count": ("pos",),
    "strmax": ("tok",),
    "max_min": ("lo", "hi"),
    "max_day": ("hi", "top"),
    "avg_day": ("sum", "top"),
    "day_div_avg": ("sum", "top"),
}


@dataclass(frozen=True)
class DayTable:
    """Day partials of a whole log, kept for many schemes; columns are told apart by their place."""

    frame: DataFrame
    columns: tuple[str, ...]
    one_row_per_day: bool = False
    table: str | None = None


@dataclass
class Plan:
    """What a scheme asks of the log: columns, states per column, window sizes."""

    features: list[Feature]
    known: tuple[str, ...] = ()
    states: dict[str, set[str]] = field(default_factory=dict)

    def __post_init__(self):
        for f in self.features:
            self.states.setdefault(f.column, set()).update(NEEDS[f.method])
        self.columns = list(self.states)
        self.slot = {c: i for i, c in enumerate(self.known or self.columns)}
        self.ts_parts = sorted({f.parts for f in self.features if f.rule == TS_RULE})

    def rules(self) -> set[str]:
        return {f.rule for f in self.features}

    def ts_states(self) -> dict[tuple[str, int], set[str]]:
        out: dict[tuple[str, int], set[str]] = {}
        for f in self.features:
            if f.rule == TS_RULE:
                out.setdefault((f.column, f.parts), set()).update(NEEDS[f.method])
        return out


def group_by_rule(scheme) -> dict[str, list[tuple[Feature, int]]]:
    """Scheme items by rule, each with its position in the scheme."""
    out: dict[str, list[tuple[Feature, int]]] = {}
    for position, item in enumerate(scheme):
        f = Feature.of(item)
        out.setdefault(f.rule, []).append((f, position))
    return out


def tie_columns(log: DataFrame, layout: Layout) -> list[str]:
    if layout.tie:
        return list(layout.tie)
    return [c for c in log.columns if c not in (*layout.user, layout.day)]


def quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]


def day_values(log: DataFrame, plan: Plan, layout: Layout, with_tie: bool = False) -> DataFrame:
    """Log rows as (user, __day, [__tie], one value and/or token count per column)."""
    ties = quoted(tie_columns(log, layout)) if with_tie else []
    values = []
    for c, states in plan.states.items():
        i = plan.slot[c]
        if states - {"tok"}:
            values.append(as_feature(log, c).alias(f"__v{i}"))
        if "tok" in states:
            text = F.col(f"`{c}`").cast("string")
            count = F.when(F.length(text) >= MIN_TOKEN_TEXT, token_count(text)).otherwise(0)
            values.append(count.cast("double").alias(f"__t{i}"))
    order = ties[0] if len(ties) == 1 else f"struct({', '.join(ties)})"
    return log.select(
        *layout.user,
        as_day(log, layout.day).alias("__day"),
        *([F.expr(f"{order} as __tie")] if ties else []),
        *values,
    ).where("__day is not null")


def daily_partials(log: DataFrame, plan: Plan, layout: Layout) -> DataFrame:
    """One row per user and day: row count and, per column, sum, squared deviations, extremes,
    positive count, token count and the value of the day's latest row, as far as asked for."""
    with_top = any("top" in s for s in plan.states.values())
    rows, aggs = day_values(log, plan, layout, with_top), ["count(1) as __n"]
    for c, states in plan.states.items():
        i = plan.slot[c]
        merge = {
            "sum": f"sum(__v{i})",
            "m2": f"var_pop(__v{i}) * count(1)",
            "lo": f"min(__v{i})",
            "hi": f"max(__v{i})",
            "pos": f"count_if(__v{i} > 0)",
            "tok": f"max(__t{i})",
            "top": f"max_by(__v{i}, __tie)" if "__tie" in rows.columns else f"max(__v{i})",
        }
        aggs += [f"{merge[state]} as __{state}{i}" for state in merge if state in states]
    return rows.groupBy(*layout.user, "__day").agg(*map(F.expr, aggs))


def prepare_days(log: DataFrame, columns, layout: Layout = Layout()) -> DayTable:
    """All partials of the given log columns, to be written once and used by many schemes."""
    states = {}
    for c in columns:
        states[c] = {"sum", "m2", "lo", "hi", "pos", "top"}
        if isinstance(log.schema[c].dataType, T.StringType):
            states[c].add("tok")
    plan = Plan([], tuple(columns), states)
    return DayTable(daily_partials(log, plan, layout), tuple(columns))


def days_for(log: DataFrame, plan: Plan, layout: Layout, days: DayTable | None) -> tuple[DataFrame, bool]:
    """The day side of the join, and whether it holds single rows instead of partials.

    Where a day has one row, that row's value is every partial there is: nothing is reduced,
    and only the value crosses the shuffle of the join.
    """
    if days is None:
        if layout.one_row_per_day:
            return day_values(log, plan, layout), True
        return daily_partials(log, plan, layout), False
    if days.one_row_per_day:
        values = [f"__sum{plan.slot[c]} as __v{plan.slot[c]}" for c in plan.columns if plan.states[c] - {"tok"}]
        values += [f"__tok{plan.slot[c]} as __t{plan.slot[c]}" for c in plan.columns if "tok" in plan.states[c]]
        return days.frame.selectExpr(*quoted(layout.user), "__day", *values), True
    wanted = [f"__{state}{plan.slot[c]}" for c in plan.columns for state in sorted(plan.states[c])]
    return days.frame.select(*layout.user, "__day", "__n", *wanted), False


def _partials_of(plan: Plan, single: bool) -> list[str]:
    """Partials of the matched day ``d``; of a single row they all follow from its value."""
    if not single:
        names = [f"__{state}{plan.slot[c]}" for c in plan.columns for state in sorted(plan.states[c])]
        return ["d.__day", "d.__n", *[f"d.{n}" for n in names]]
    out = ["d.__day", "if(d.__day is null, null, 1) as __n"]
    for c in plan.columns:
        i = plan.slot[c]
        value = {"m2": "if(d.__day is null, null, 0d)", "pos": f"if(d.__v{i} > 0, 1, 0)", "tok": f"d.__t{i}"}
        out += [f"{value.get(state, f'd.__v{i}')} as __{state}{i}" for state in sorted(plan.states[c])]
    return out


def day_prefixes(log: DataFrame, plan: Plan, layout: Layout, depth: int) -> DataFrame:
    """(user, __day, __prefix): the running totals over a day's latest rows, by the number of rows less one.

    There are totals of at most ``depth`` rows, and never of the whole day: a window that takes it whole
    does not cut it. Days with a single row are left out.
    """
    wanted: dict[str, set[str]] = {}
    for (c, _), states in plan.ts_states().items():
        wanted.setdefault(c, set()).update(states)
    ties = tie_columns(log, layout)
    tie_names = [f"__tie{j}" for j in range(len(ties))]
    rows = log.select(
        *layout.user,
        as_day(log, layout.day).alias("__day"),
        *[F.col(f"`{c}`").alias(t) for c, t in zip(ties, tie_names)],
        *[as_feature(log, c).alias(f"__v{plan.slot[c]}") for c in wanted],
    ).where("__day is not null")
    latest = [F.col(t).desc() for t in tie_names] or [F.lit(1)]
    kept = depth + 1  # one row more tells whether the day goes on
    if kept > int(log.sparkSession.conf.get(PUSHED_LIMIT, "1000")):
        rows = rows.withColumn("__deal", F.pmod(F.xxhash64(*tie_names), F.lit(DAY_SALTS)))
        dealt = Window.partitionBy(*layout.user, "__day", "__deal").orderBy(*latest)
        rows = rows.withColumn("__rank", F.row_number().over(dealt)).where(f"__rank <= {kept}")
    in_day = Window.partitionBy(*layout.user, "__day").orderBy(*latest)
    ranked = rows.withColumn("__rank", F.row_number().over(in_day)).where(f"__rank <= {kept}")

    in_order = f"over (partition by {', '.join(quoted(layout.user))}, __day order by __rank"
    over = f"{in_order} rows between unbounded preceding and current row)"
    out = [*quoted(layout.user), "__day", "__rank", f"lead(1) {in_order}) is not null as __more"]
    totals = ["'rank', __rank"]
    for c, states in wanted.items():
        i = plan.slot[c]
        running = {
            "sum": f"sum(__v{i}) {over}",
            "m2": f"var_pop(__v{i}) {over} * __rank",
            "lo": f"min(__v{i}) {over}",
            "hi": f"max(__v{i}) {over}",
        }
        names = [state for state in running if state in states]
        out += [f"{running[state]} as __p{state}{i}" for state in names]
        totals += [f"'p{state}{i}', __p{state}{i}" for state in names]
    folded = F.expr(f"array_sort(collect_list(named_struct({', '.join(totals)}))) as __prefix")
    return ranked.selectExpr(*out).where("__more").groupBy(*layout.user, "__day").agg(folded)


def prefix_names(plan: Plan) -> list[str]:
    """Fields of the totals in ``day_prefixes``."""
    states: dict[str, set[str]] = {}
    for (c, _), needed in plan.ts_states().items():
        states.setdefault(c, set()).update(needed)
    return [f"p{state}{plan.slot[c]}" for c, needed in states.items() for state in ("sum", "m2", "lo", "hi") if state in needed]


def look_up_cuts(rows: DataFrame, prefixes: DataFrame, plan: Plan, layout: Layout, suffix: str = "") -> DataFrame:
    """Add to ``rows`` the totals of the latest ``__askrows`` rows of ``__askday``, null where nothing is asked."""
    same = " and ".join(f"r.`{u}` = p.`{u}`" for u in layout.user)
    found = rows.alias("r").join(prefixes.alias("p"), F.expr(f"{same} and r.__askday = p.__day"), "left")
    names = prefix_names(plan)
    at = "get(p.__prefix, r.__askrows - 1)"
    return found.selectExpr("r.*", *[f"{at}.{n} as __{n}{suffix}" for n in names])


def generate(
    instances: DataFrame,
    log: DataFrame,
    scheme,
    layout: Layout = Layout(),
    *,
    mask: str = "zero",
    direction: str = "right",
    days_per_part: float = DAYS_PER_PART,
    max_parts: int | None = None,
    na: float = 0.0,
    days: DayTable | None = None,
    hot: DataFrame | None | str = "find",
) -> tuple[DataFrame, dict[str, tuple[Feature, int]]]:
    """Compute one row per instance with one column per scheme item.

    ``mask="zero"`` lets rows outside the window, but inside the rule's domain, count as 0;
    ``mask="null"`` leaves them out. ``max_parts`` is the row depth of the ts rule's domain,
    by default the largest window of that rule in the scheme. Returns the table and the
    lineage: column name -> (feature, position in the scheme). Instance rows must be unique
    on the instance key together with the carried columns. ``days`` spares the first pass over
    the log when its day partials are at hand, and ``hot`` the look for hot users (None: there
    are none).
    """
    if mask not in ("zero", "null"):
        raise ValueError("mask is 'zero' or 'null'")
    if direction not in ("right", "left"):
        raise ValueError("direction is 'right' or 'left'")
    lineage: dict[str, tuple[Feature, int]] = {}
    grouped = group_by_rule(scheme)
    for rule in (ALL_RULE, PART_RULE, TS_RULE):
        for f, position in grouped.get(rule, []):
            lineage.setdefault(f.name, (f, position))
    key = [c for c in layout.instance] + [
        c for c in layout.carry if c in instances.columns and c not in layout.instance
    ]
    if not lineage:
        return instances.select(*key), lineage

    plan = Plan([f for f, _ in lineage.values()], days.columns if days else ())
    if ALL_RULE in plan.rules() and layout.first is None:
        raise ValueError("the 'all' rule needs a first column")
    depth = max(plan.ts_parts, default=0) if max_parts is None else max_parts
    if plan.ts_parts and depth < plan.ts_parts[-1]:
        raise ValueError("max_parts is below the largest window of the scheme")

    domains = _domains(layout)
    masks = {f: _mask(f, layout, direction, days_per_part) for f in plan.features}
    joined, salt = _join_days(instances, days_for(log, plan, layout, days), plan, layout, key, domains, hot)
    ts = bool(plan.ts_parts)
    group = [*key, *salt]
    inside = domains[TS_RULE]
    if ts:
        joined = joined.withColumn(
            "__later",
            F.expr(
                f"coalesce(sum(if({inside}, __n, 0)) over (partition by {', '.join(quoted(group))} "
                "order by __day desc rows between unbounded preceding and 1 preceding), 0)"
            ),
        )

    # First pass: masked merges of whole days.
    aggs: dict[str, str] = {}
    for f in plan.features:
        i, (tag, hit) = plan.slot[f.column], masks[f]
        needs = NEEDS[f.method]
        aggs[f"__N_{f.rule}"] = f"sum(if({domains[f.rule]}, __n, 0))"
        aggs[f"__cnt_{tag}"] = f"sum(if({hit}, __n, 0))"
        merge = {"sum": "sum", "lo": "min", "hi": "max", "pos": "sum", "tok": "max"}
        for state, call in merge.items():
            if state in needs:
                aggs[f"__{state}{i}_{tag}"] = f"{call}(if({hit}, __{state}{i}, null))"
        if "top" in needs:
            aggs[f"__top{i}"] = f"max(if({inside} and __later = 0, __top{i}, null))"
        if "m2" in needs:
            gap = f"(__sum{i} / __n - __mid{i})"
            aggs[f"__mid{i}"] = f"max(__mid{i})"
            aggs[f"__q{i}_{tag}"] = f"sum(if({hit}, __m2{i} + __n * {gap} * {gap}, null))"
    sums = list(aggs)
    cut = ts and not layout.one_row_per_day and not (days and days.one_row_per_day)
    if cut:
        for p in plan.ts_parts:
            through = f"{inside} and __later < {p} and __later + __n > {p}"
            aggs[f"__cutday{p}"] = f"max(if({through}, __day, null))"
            aggs[f"__cutrows{p}"] = f"max(if({through}, cast({p} - __later as int), null))"
    table = joined.groupBy(*group).agg(*[F.expr(f"{e} as {n}") for n, e in aggs.items()])

    # Second pass, ts rule only: the part of a day that a window cuts through.
    if cut:
        table = _add_cut_days(table, log, plan, layout, key, sums)

    features = []
    for f in plan.features:
        value = _value(f, plan, mask, depth, cut, masks[f][0])
        kind = "bigint" if f.method in ("count", "strmax") else "double"
        features.append(f"coalesce(cast({value} as {kind}), cast({na} as {kind})) as `{f.name}`")
    return table.selectExpr(*quoted(key), *features), lineage


def _domains(layout: Layout) -> dict[str, str]:
    """Which days count at all, per rule."""
    after = "__day >= __first" if layout.first else "__day is not null"
    before = "__day <= __last"
    return {ALL_RULE: f"({after})", PART_RULE: f"({before})", TS_RULE: f"({after} and {before})"}


def _mask(f: Feature, layout: Layout, direction: str, days_per_part: float) -> tuple[str, str]:
    """Which days keep their value, with a short tag for the window."""
    domains = _domains(layout)
    if f.rule == ALL_RULE:
        return "a", domains[TS_RULE]
    if f.rule == TS_RULE:
        return f"c{f.parts}", f"({domains[TS_RULE]} and __later + __n <= {f.parts})"
    if direction == "left" and layout.first:
        end = part_days(f.parts, days_per_part)
        hit = f"__day < date_add(__first, {end})"
        return f"b{f.parts}", f"({domains[TS_RULE]} and {hit})"
    start = part_days(-f.parts, days_per_part)
    return f"b{f.parts}", f"({domains[PART_RULE]} and __day > date_add(__last, {start}))"


def _join_days(
    instances: DataFrame,
    days_side: tuple[DataFrame, bool],
    plan: Plan,
    layout: Layout,
    key: list[str],
    domains: dict[str, str],
    hot: DataFrame | None | str,
) -> tuple[DataFrame, list[str]]:
    """Instances left joined to the days any rule of the scheme can see, and the salt column if any."""
    days, single = days_side
    side = instances.select(
        *key,
        *([as_day(instances, layout.first).alias("__first")] if layout.first else []),
        as_day(instances, layout.last).alias("__last"),
    )
    salt = []
    if layout.one_instance_per_user:
        hot = None
    elif isinstance(hot, str):
        hot = find_hot_users(instances, layout.user)
    if hot is not None:
        side, days = spread(side, days, hot, layout.user, tuple(c for c in key if c not in layout.user))
        salt = [SALT]
    on = [*layout.user, *salt]

    deviating = [plan.slot[c] for c in plan.columns if "m2" in plan.states[c]]
    if deviating:
        whole = f"over (partition by {', '.join(quoted(on))})"
        mean = "avg(__v{0}) {1}" if single else "sum(__sum{0}) {1} / sum(__n) {1}"
        days = days.selectExpr("*", *[f"{mean.format(i, whole)} as __mid{i}" for i in deviating])
    visible = " or ".join(domains[rule] for rule in sorted(plan.rules()))
    same = " and ".join(f"i.`{c}` = d.`{c}`" for c in on)
    keep = _partials_of(plan, single) + [f"d.__mid{i}" for i in deviating]
    match = F.expr(f"{same} and ({visible})")
    return side.alias("i").join(days.alias("d"), match, "left").selectExpr("i.*", *keep), salt


def _add_cut_days(
    table: DataFrame, log: DataFrame, plan: Plan, layout: Layout, key: list[str], sums: list[str]
) -> DataFrame:
    """Look up, per instance and window size, the running totals of the day the window cuts through."""
    asks = ", ".join(
        f"named_struct('parts', {p}, 'day', __cutday{p}, 'rows', __cutrows{p})" for p in plan.ts_parts
    )
    keys = quoted(key)
    rows = table.selectExpr(
        *keys, *sums, f"posexplode_outer(filter(array({asks}), a -> a.day is not null)) as (__at, __ask)"
    )
    # The totals ride on the first row of each instance only.
    rows = rows.selectExpr(
        *keys,
        *[f"if(coalesce(__at, 0) = 0, {s}, null) as {s}" for s in sums],
        "__ask.parts as __parts",
        "__ask.day as __askday",
        "__ask.rows as __askrows",
    )
    looked = look_up_cuts(rows, day_prefixes(log, plan, layout, plan.ts_parts[-1]), plan, layout)

    aggs = [f"max({s}) as {s}" for s in sums]
    aggs += [f"max(if(__parts = {p}, __askrows, null)) as __pcnt_c{p}" for p in plan.ts_parts]
    for (c, p), states in plan.ts_states().items():
        for state in ("sum", "m2", "lo", "hi"):
            if state in states:
                name = f"__p{state}{plan.slot[c]}"
                aggs.append(f"max(if(__parts = {p}, {name}, null)) as {name}_c{p}")
    return looked.groupBy(*key).agg(*map(F.expr, aggs))


def _value(f: Feature, plan: Plan, mask: str, depth: int, cut: bool, tag: str) -> str:
    """The feature itself, from the merged states of its window and the size of its domain."""
    i, needs = plan.slot[f.column], NEEDS[f.method]
    patched = cut and f.rule == TS_RULE
    rows, part = f"coalesce(__pcnt_{tag}, 0)", {s: f"__p{s}{i}_{tag}" for s in ("sum", "m2", "lo", "hi")}

    count = f"(__cnt_{tag} + {rows})" if patched else f"__cnt_{tag}"
    domain = f"__N_{f.rule}"
    if f.rule == TS_RULE:
        domain = f"least({domain}, {depth})"
    if mask == "null":
        domain = count
    zeros = f"({domain} - {count})"

    def extreme(state: str, pick: str) -> str:
        # least and greatest skip NULL, so an empty side does not count.
        inner = f"__{state}{i}_{tag}"
        if patched:
            inner = f"{pick}({inner}, {part[state]})"
        return f"if({zeros} > 0, {pick}({inner}, 0d), {inner})"

    total = f"coalesce(__sum{i}_{tag}, 0d)"
    if patched and "sum" in needs:
        total = f"({total} + coalesce({part['sum']}, 0d))"
    mean = f"if({domain} > 0, {total} / {domain}, null)"
    low, high = extreme("lo", "least"), extreme("hi", "greatest")

    simple = {
        "min": low,
        "max": high,
        "sum": total,
        "avg": mean,
        "count": f"__pos{i}_{tag}",
        "strmax": f"__tok{i}_{tag}",
        "max_min": f"coalesce({high}, 0d) - coalesce({low}, 0d)",
    }
    if f.method in simple:
        return simple[f.method]
    if f.method in ("std", "stddev"):
        # Squared deviations about the user's overall mean, moved to the mean of the domain.
        mid = f"coalesce(__mid{i}, 0d)"
        squares = f"coalesce(__q{i}_{tag}, 0d)"
        if patched:
            gap = f"({part['sum']} / {rows} - {mid})"
            squares = f"({squares} + if({rows} > 0, {part['m2']} + {rows} * {gap} * {gap}, 0d))"
        offset = f"({total} - {domain} * {mid})"
        squares = f"({squares} + {zeros} * {mid} * {mid} - {offset} * {offset} / {domain})"
        deviation = f"sqrt(greatest({squares} / ({domain} - 1), 0d))"
        return f"case when {domain} <= 1 then 0d when {low} = {high} then 0d else {deviation} end"

    # Methods that compare the window with its latest row.
    latest = f"coalesce(if({domain} > 1, greatest(__top{i}, 0d), __top{i}), 0d)"
    if mask == "null":
        latest = f"coalesce(__top{i}, 0d)"
    if f.method == "max_day":
        return f"coalesce({high}, 0d) - {latest}"
    if f.method == "avg_day":
        return f"coalesce({mean}, 0d) - {latest}"
    # Fixed value: a missing mean counts as 0.01; a mean of zero gives zero.
    return f"try_divide({latest}, coalesce({mean}, 0.01d))"


def lineage_frame(spark: SparkSession, lineage: dict[str, tuple[Feature, int]]) -> DataFrame:
    """Lineage as a table: feature name, source column, rule, method, parts, position in the scheme."""
    schema = "feature string, column string, rule string, method string, parts int, position int"
    rows = [(n, f.column, f.rule, f.method, f.parts, i) for n, (f, i) in lineage.items()]
    return spark.createDataFrame(rows, schema)
