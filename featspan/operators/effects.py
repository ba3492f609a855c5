"""Shrunken effects: what attributes and their combinations add to a value, fitted stage by stage.

The first stage is the mean. Every further one takes the cells of some attributes, and a cell's
effect is the mean of what earlier stages leave over in it, drawn towards 0 as if ``shrink`` further
rows of the cell left nothing. Rows may count several times (``weight``). Stages go from single attributes to combinations, so a combination
adds only what its parts do not explain, and one seen rarely adds little.

A history has at most rounds times features (or nodes) rows, all effects fewer than that per stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featspan.session import materialise

Stages = tuple[tuple[str, ...], ...]


def with_attributes(df: DataFrame, prefix: str = "") -> DataFrame:
    """Add texts of the scheme fields: method and window with their rule, and the window to within a doubling."""
    sized = F.coalesce(F.col("parts").cast("string"), F.lit("None"))
    doublings = F.coalesce(F.length(F.bin(F.col("parts").cast("long"))), F.lit(0)).cast("string")
    texts = {
        "column": F.col("column"),
        "method": F.concat_ws("/", "rule", "method"),
        "band": F.concat_ws("/", "rule", doublings),
        "window": F.concat_ws("/", "rule", sized),
    }
    return df.withColumns({f"{prefix}at_{name}": text for name, text in texts.items()})


def _cell(stage: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *stage) if stage else F.lit("")


def fit_effects(train: DataFrame, stages: Stages, targets: list[str], shrink: float = 1.0, weight: Column | None = None) -> DataFrame:
    """(stage, cell, targets...): the effects of each stage's cells on each target; no rows without a history."""
    every = ((), *stages)
    cells = [_cell(s).alias(f"__cell{i}") for i, s in enumerate(every)]
    times = (F.lit(1.0) if weight is None else weight).cast("double").alias("__w")
    rest = train.select(*cells, times, *[F.col(t).cast("double").alias(t) for t in targets])
    for i in range(len(every)):
        here = Window.partitionBy(f"__cell{i}")
        n = F.sum("__w").over(here) + (shrink if i else 0.0)
        rest = rest.withColumns({f"__{t}{i}": F.sum(F.col("__w") * F.col(t)).over(here) / n for t in targets})
        rest = rest.withColumns({t: F.col(t) - F.col(f"__{t}{i}") for t in targets})
    rest = materialise(rest, "effects")
    rows = [
        F.struct(F.lit(i).alias("stage"), F.col(f"__cell{i}").alias("cell"), *[F.col(f"__{t}{i}").alias(t) for t in targets])
        for i in range(len(every))
    ]
    return rest.select(F.inline(F.array(*rows))).groupBy("stage", "cell").agg(*[F.max(t).alias(t) for t in targets])


def add_expected(rows: DataFrame, key: str, effects: DataFrame, stages: Stages, targets: list[str]) -> DataFrame:
    """``rows`` (one per ``key``) with the sum of the effects of their cells, as ``<target>_hat``; 0 without any."""
    cells = [F.struct(F.lit(i).alias("stage"), _cell(s).alias("cell")) for i, s in enumerate(((), *stages))]
    found = rows.select(key, F.inline(F.array(*cells))).join(effects, ["stage", "cell"])
    summed = found.groupBy(key).agg(*[F.sum(t).alias(f"{t}_hat") for t in targets])
    return rows.join(summed, key, "left").na.fill(0.0, [f"{t}_hat" for t in targets])
