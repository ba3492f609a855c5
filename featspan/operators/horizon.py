"""One column at every window size of a grid, in one pass.

A day belongs to the smallest window that holds it, so days are merged once per (instance,
smallest window) and windows follow by running merges. The cost no longer grows with the number
of window sizes, and the result is long: one row per instance and window size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featspan.config import PART_RULE, TS_RULE, Feature, Layout
from featspan.functions.days import DAYS_PER_PART, part_days
from featspan.operators.generate import (
    NEEDS,
    DayTable,
    Plan,
    _domains,
    _join_days,
    _value,
    day_prefixes,
    days_for,
    look_up_cuts,
    quoted,
)

#: Methods that have a form over all window sizes at once.
PROFILED = ("min", "max", "sum", "avg", "std", "count", "max_min", "max_day", "avg_day", "day_div_avg")


def profile(
    instances: DataFrame,
    log: DataFrame,
    columns: list[str],
    grid: list[int],
    layout: Layout = Layout(),
    *,
    rule: str = PART_RULE,
    methods: tuple[str, ...] = ("min", "max", "sum", "avg", "std"),
    mask: str = "zero",
    direction: str = "right",
    days_per_part: float = DAYS_PER_PART,
    max_parts: int | None = None,
    days: DayTable | None = None,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """(instance key, parts, <column>_<method>...) for every size in the ascending ``grid``.

    Each row holds what ``generate`` gives for that window size, with ``max_parts`` being the
    largest size unless told otherwise.
    """
    if not grid or list(grid) != sorted(set(grid)):
        raise ValueError("grid must be ascending and not empty")
    if rule not in (PART_RULE, TS_RULE):
        raise ValueError("only windowed rules have window sizes")
    if refused := sorted(set(methods) - set(PROFILED)):
        raise ValueError(f"no profile of {', '.join(refused)}: generate a scheme with one feature per window size")
    features = [Feature(c, rule, m, grid[0]) for c in columns for m in methods]
    plan = Plan(features, days.columns if days else ())
    key = [*layout.instance, *[c for c in layout.carry if c in instances.columns and c not in layout.instance]]
    domains = _domains(layout)
    joined, salt = _join_days(instances, days_for(log, plan, layout, days), plan, layout, key, domains, hot)
    group, beyond = [*key, *salt], len(grid) + 1
    depth = grid[-1] if max_parts is None else max_parts
    if rule == TS_RULE:
        if depth < grid[-1]:
            raise ValueError("max_parts is below the largest window of the grid")
        joined = joined.withColumn(
            "__later",
            F.expr(
                f"coalesce(sum(if({domains[rule]}, __n, 0)) over (partition by {', '.join(quoted(group))} "
                "order by __day desc rows between unbounded preceding and 1 preceding), 0)"
            ),
        )
        slot = _slot("__later + __n", list(grid), "<")
    elif direction == "left" and layout.first:
        slot = _slot("datediff(__day, __first)", [part_days(p, days_per_part) for p in grid], "<=")
        slot = f"if(__day < __first, {beyond}, {slot})"
    else:
        slot = _slot("datediff(__last, __day)", [-part_days(-p, days_per_part) for p in grid], "<=")
    joined = joined.withColumn("__slot", F.expr(f"if({domains[rule]}, {slot}, {beyond})"))
    sizes = f"array({', '.join(map(str, grid))})"
    one_a_day = layout.one_row_per_day or bool(days and days.one_row_per_day)
    cut = rule == TS_RULE and not one_a_day

    merge = {"sum": "sum", "lo": "min", "hi": "max", "pos": "sum", "q": "sum"}
    states = []
    aggs = [f"sum(if({domains[rule]}, __n, 0)) as __cnt"]
    for c in plan.columns:
        i = plan.slot[c]
        for state in sorted(plan.states[c] - {"top"}):
            expr = f"__{state}{i}"
            if state == "m2":
                gap = f"(__sum{i} / __n - __mid{i})"
                state, expr = "q", f"__m2{i} + __n * {gap} * {gap}"
            states.append((state, f"__{state}{i}"))
            aggs.append(f"{merge[state]}({expr}) as __{state}{i}")
        if "m2" in plan.states[c]:
            aggs.append(f"max(__mid{i}) as __mid{i}")
        if "top" in plan.states[c]:
            aggs.append(f"max(if({domains[rule]} and __later = 0, __top{i}, null)) as __top{i}")
    if cut:
        # The day that reaches into a slot from below is cut by every size between; a slot has at most one.
        reaches = f"{domains[rule]} and __slot > 1 and __later < element_at({sizes}, greatest(__slot - 1, 1))"
        aggs += [f"max(if({reaches}, {x}, null)) as {name}" for x, name in (("__day", "__cutday"), ("__later", "__cutlater"))]
    partial = joined.groupBy(*group, "__slot").agg(*map(F.expr, aggs))

    # Running merges over the slots of each instance; an instance has at most one row per slot.
    mids = [f"__mid{plan.slot[c]}" for c in plan.columns if "m2" in plan.states[c]]
    mids += [f"__top{plan.slot[c]}" for c in plan.columns if "top" in plan.states[c]]
    whole = f"over (partition by {', '.join(quoted(group))})"
    ordered = f"over (partition by {', '.join(quoted(group))} order by __slot"
    so_far = f"{ordered} rows between unbounded preceding and current row)"
    running = partial.selectExpr(
        *quoted(group),
        "__slot",
        f"lead(__slot, 1, {beyond}) {ordered}) as __next",
        f"row_number() {ordered}) = 1 as __lead",
        f"sum(__cnt) {whole} as __N_{rule}",
        f"sum(__cnt) {so_far} as __cnt_h",
        *[f"{merge[state]}({name}) {so_far} as {name}_h" for state, name in states],
        *[f"max({m}) {whole} as {m}" for m in mids],
        *([x for c in ("__cutday", "__cutlater") for x in (c, f"lead({c}) {ordered}) as __next{c[2:]}")] if cut else []),
    )
    # A slot's totals hold until the next slot; sizes below the first slot are empty windows. Sizes beyond
    # the rows before the next slot's first day cut through it.
    asks = [f", 'askday', {p}day, 'later', {p}later" if cut else "" for p in ("__nextcut", "__cut")]
    running = running.selectExpr(
        "*",
        f"inline(filter(array(named_struct('lo', __slot, 'hi', __next - 1, 'empty', false{asks[0]}), "
        f"named_struct('lo', 1, 'hi', if(__lead, __slot - 1, 0), 'empty', true{asks[1]})), s -> s.lo <= s.hi))",
    ).withColumn("__size", F.explode(F.sequence("lo", "hi")))
    table = running.selectExpr(
        *quoted(group),
        "__size",
        f"element_at({sizes}, __size) as parts",
        f"__N_{rule}",
        *mids,
        "if(empty, 0, __cnt_h) as __cnt_h",
        *[f"if(empty, null, {name}_h) as {name}_h" for _, name in states],
        *(["askday as __askday", f"cast(nullif(greatest(element_at({sizes}, __size) - later, 0), 0) as int) as __askrows"] if cut else []),
    )
    if cut:
        table = table.withColumn("__pcnt_h", F.col("__askrows"))
        table = look_up_cuts(table, day_prefixes(log, plan, layout, grid[-1]), plan, layout, "_h")
    out = []
    for f in features:
        kind = "bigint" if f.method == "count" else "double"
        value = _value(f, plan, mask, depth, cut, "h")
        out.append(f"coalesce(cast({value} as {kind}), cast(0 as {kind})) as `{f.column}_{f.method}`")
    return table.selectExpr(*quoted(key), "parts", *out)


def _slot(value: str, bounds: list[int], below: str) -> str:
    """1-based place of the first bound above ``value`` (not below it for ``<``)."""
    step = bounds[0]
    if bounds == [step * i for i in range(1, len(bounds) + 1)]:
        even = f"floor(({value}) / {step}) + 1" if below == "<=" else f"ceil(({value}) / {step})"
        return f"cast(least({even}, {len(bounds) + 1}) as int)"
    listed = ", ".join(map(str, bounds))
    return f"size(filter(array({listed}), b -> b {below} ({value}))) + 1"

