"""Drawing candidates: even and biased draws without repeats, draws with repeats, budgeted mixes.

Draws use a variate hashed from the feature name and a seed. Keeping the smallest
``-ln(u) / weight`` is drawing one after another with those weights and rejecting repeats, but it
is a plain distributed top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from featspan.functions.scalars import unit_hash

KEY_SHARE = 0.3  # fixed value: chance that the column comes from the key features
REPLAY_SHARE = 0.8  # fixed value: chance that a round replays the best trial
FIELDS = ("column", "rule", "method", "parts", "feature")


def draw_order(weight: Column, seed: int | str, of: str = "feature") -> Column:
    u = F.greatest(unit_hash(of, salt=str(seed)), F.lit(2.0**-53))
    return -F.log(u) / weight


def ranked(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (ties by feature name), numbered from 1."""
    top = df.orderBy(order, "feature").limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(order, "feature")))


def sample_uniform(candidates: DataFrame, n: int, seed: int | str) -> DataFrame:
    """``n`` different candidates in draw order."""
    drawn = candidates.withColumn("__draw", draw_order(F.col("weight"), seed))
    return ranked(drawn, "__draw", n).select(*FIELDS, "position")


def key_names(key_columns: DataFrame | Sequence[str]) -> list[str]:
    """The key columns by name; there are no more of them than columns in the log."""
    if isinstance(key_columns, DataFrame):
        key_columns = [r["column"] for r in key_columns.select("column").distinct().collect()]
    return sorted(set(key_columns))


def biased_weight(candidates: DataFrame, key_columns: DataFrame | Sequence[str], share: float = KEY_SHARE) -> DataFrame:
    """Reweight so that with chance ``share`` the column is drawn from ``key_columns`` (their names, or a table of them).

    Without key columns the weights stay as they are. Names travel as literals, so both weights come
    from one pass over the candidates.
    """
    keys = key_names(key_columns)
    if not keys:
        return candidates
    from_keys = F.when(F.col("column").isin(keys), F.col("weight") * F.col("n_columns") / len(keys)).otherwise(0.0)
    return candidates.withColumn("weight", share * from_keys + (1 - share) * F.col("weight"))


def sample_biased(
    candidates: DataFrame, key_columns: DataFrame | Sequence[str], n: int, seed: int | str, share: float = KEY_SHARE
) -> DataFrame:
    return sample_uniform(biased_weight(candidates, key_columns, share), n, seed)


def sample_replace(pool: DataFrame, n: int, seed: int | str) -> DataFrame:
    """``n`` draws with repeats from a pool numbered 1..m by ``position``; ``draw`` numbers them."""
    spark = pool.sparkSession
    size = pool.agg(F.max("position").alias("m")).scalar()
    draws = spark.range(1, n + 1).select(F.col("id").alias("draw"))
    u = unit_hash(F.col("draw").cast("string"), salt=f"/{seed}")
    draws = draws.withColumn("position", (F.floor(u * size) + 1).cast("int"))
    return draws.join(pool, "position").drop("position")


def random_fill(candidates: DataFrame, chosen: DataFrame, n: int, seed: int | str) -> DataFrame:
    """``n`` further candidates, none of them chosen already."""
    return sample_uniform(candidates.join(chosen.select("feature"), "feature", "left_anti"), n, seed)


def lineage_lookup(features: DataFrame, candidates: DataFrame) -> DataFrame:
    """Source column, rule, method and window of generated columns, by name."""
    return features.join(candidates.select(*FIELDS), "feature", "left")


def budgets(selectors, n: int) -> list[int]:
    """How many slots are filled once each selector had its turn: equal shares, rounded down, but
    at least one slot for the replay of the best trial."""
    rate, total, out = 1.0 / len(selectors), 0.0, []
    for name in selectors:
        total += rate
        out.append(max(int(n * rate), 1) if name == "best_scheme_sample" else int(n * total))
    return out


def mix(selectors: list[DataFrame], caps: list[int], n: int) -> DataFrame:
    """Fill ``n`` slots selector by selector.

    Each selector is a ranked list (feature, position). The j-th one tops the choice up to
    ``caps[j]`` features, skipping what is chosen already. At most 2 n rows of each list can
    matter, so each travels as one small array.
    """
    lists = []
    for at, (df, cap) in enumerate(zip(selectors, caps)):
        head = df.select("feature", "position").orderBy("position", "feature").limit(2 * n)
        packed = F.transform(
            F.array_sort(F.collect_list(F.struct("position", "feature"))), lambda r: r["feature"]
        )
        lists.append(head.agg(packed.alias("features")).select(F.lit(at).alias("at"), F.lit(cap).alias("cap"), "features"))
    united = lists[0]
    for df in lists[1:]:
        united = united.unionByName(df)
    steps = united.agg(F.array_sort(F.collect_list(F.struct("at", "cap", "features"))).alias("steps"))
    chosen = F.aggregate(
        "steps",
        F.array().cast("array<string>"),
        lambda done, step: F.concat(
            done,
            F.slice(
                F.array_except(step["features"], done),
                F.lit(1),
                F.greatest(step["cap"] - F.size(done), F.lit(0)),
            ),
        ),
    )
    return steps.select(F.posexplode(chosen).alias("position", "feature")).select(
        "feature", (F.col("position") + 1).alias("position")
    )
