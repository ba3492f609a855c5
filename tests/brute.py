"""Features from first principles, one instance at a time, for small tables."""

import math
import statistics
from datetime import timedelta

from featspan.config import ALL_RULE, PART_RULE, TS_RULE


def feature(instance, rows, f, depth, direction="right", mask="zero", days_per_part=2.5):
    """``instance``: (user, first, last); ``rows``: (user, day, tie, {column: value})."""
    user, first, last = instance
    mine = [r for r in rows if r[0] == user]
    if f.rule == ALL_RULE:
        domain = [(r, r[1] <= last) for r in mine if r[1] >= first]
    elif f.rule == PART_RULE:
        seen = [r for r in mine if r[1] <= last]
        if direction == "left" and first is not None:
            end = first + timedelta(days=math.floor(days_per_part * f.parts))
            domain = [(r, first <= r[1] < end) for r in seen]
        else:
            start = last - timedelta(days=math.ceil(days_per_part * f.parts))
            domain = [(r, r[1] > start) for r in seen]
    else:
        seen = [r for r in mine if r[1] <= last and (first is None or r[1] >= first)]
        seen.sort(key=lambda r: (r[1], r[2]), reverse=True)
        domain = [(r, i < f.parts) for i, r in enumerate(seen[:depth])]
    values = [float(r[3][f.column]) if hit else 0.0 for r, hit in domain if hit or mask == "zero"]
    hits = [float(r[3][f.column]) for r, hit in domain if hit]
    if f.method == "count":
        return sum(1 for x in hits if x > 0)
    if not values:
        return 0.0
    mean = sum(values) / len(values)
    if f.method in ("std", "stddev"):
        return statistics.stdev(values) if len(values) > 1 else 0.0
    if f.rule == TS_RULE:
        latest = [float(r[3][f.column]) if i == 0 else 0.0 for i, (r, _) in enumerate(domain)]
        latest = max(latest) if mask == "zero" else latest[0]
    return {
        "min": lambda: min(values),
        "max": lambda: max(values),
        "sum": lambda: sum(values),
        "avg": lambda: mean,
        "max_min": lambda: max(values) - min(values),
        "max_day": lambda: max(values) - latest,
        "avg_day": lambda: mean - latest,
        "day_div_avg": lambda: latest / mean if mean else 0.0,
    }[f.method]()
