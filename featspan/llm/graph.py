"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featspan.llm.storage import materialise


def _print_of(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over them, to see whether a round changed anything."""
    low = F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))  # so that the sum cannot overflow
    row = edges.agg(F.count(F.lit(1)), F.sum(low)).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component_id) for every end of ``edges`` (u, v): the smallest id reachable from it.

    In a round every node first hangs its larger neighbours on its smallest one, then its smaller
    ones too, until only stars are left; the number of rounds grows with the logarithm of the
    longest path. Minima are combined before the shuffle and joined back, so that a node with very
    many edges is split like any skewed join. Each round is a written table. Null ends, loops and
    repeated edges are left out.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    stars = materialise(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = _print_of(stars)
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = materialise(hung, "edges")
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _print_of(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = stars.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ends.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
