"""Deterministic random order: hash variate, global row number, hold-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from featspan.functions.scalars import unit_hash
from featspan.session import materialise

BUCKETS = 4096
# Different rows that a slice of the order should hold.
SLICE_ROWS = 1 << 20
# Equal rows are numbered together and unfolded in runs of at most this many.
RUN = 100_000


def global_row_number(
    df: DataFrame,
    by: tuple[str, ...] = (),
    *,
    salt: str = "",
    variate: str = "rand_num",
    name: str = "row_num",
    buckets: int = BUCKETS,
    times: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Number all rows 1..n in the order of a hash variate, without sorting them in one place.

    The variate hashes the ``by`` columns (default: the whole row); rows of the same variate follow a
    hash of the row, then their columns. Equal rows are first folded into one with a count, so a row
    repeated without end is one row; ``times`` names that count if the caller folded them.

    Rows are counted per bucket of the variate (one job; ``buckets`` counts reach the driver) and numbered
    within slices. Where all buckets are small they are the slices. Else buckets are cut finer, by their own
    counts, into slices of about ``slice_rows`` rows, and a variate that alone fills more than such a slice, as
    a coarse ``by`` makes them, is cut by the hash of the row. The numbers are the same however slices are cut.
    """
    columns = [c for c in df.columns if c != times]
    by = tuple(by) or tuple(columns)
    if times:
        folded = df.withColumnRenamed(times, "__times")
    else:
        folded = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__times"))
    folded = folded.withColumn(variate, unit_hash(*by, salt=salt)).withColumns(
        {"__bucket": F.floor(F.col(variate) * buckets).cast("int"), "__hash": F.xxhash64(*columns)}
    )
    counted = folded.groupBy("__bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("__times").alias("size"))
    counts = {r["__bucket"]: (r["rows"], r["size"]) for r in counted.collect()}
    offsets, total = [], 0
    for k in range(buckets):
        offsets.append(total)
        total += counts.get(k, (0, 0))[1]
    offset = F.get(_numbers(offsets), F.col("__bucket"))
    if max((rows for rows, _ in counts.values()), default=0) <= 4 * slice_rows:
        placed, keys = folded.withColumn("__offset", offset), ["__bucket"]
    else:
        fine = [-(-counts.get(k, (1, 0))[0] // slice_rows) or 1 for k in range(buckets)]
        placed, keys = _fine_slices(folded, variate, buckets, fine, slice_rows, offset)
    within = (
        Window.partitionBy(*keys)
        .orderBy(variate, "__hash", *columns)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = placed.withColumn("__until", F.col("__offset") + F.sum("__times").over(within))
    runs = numbered.withColumn(
        "__from", F.explode(F.sequence(F.col("__until") - F.col("__times") + 1, F.col("__until"), F.lit(RUN)))
    )
    return runs.select(
        *columns,
        variate,
        F.explode(F.sequence("__from", F.least(F.col("__from") + RUN - 1, F.col("__until")))).alias(name),
    )


def _numbers(values: list[int]) -> Column:
    """A literal array, in one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _fine_slices(
    folded: DataFrame, variate: str, buckets: int, fine: list[int], slice_rows: int, offset: Column
) -> tuple[DataFrame, list[str]]:
    """Rows with their slice (__bucket, __part, __turn) and its offset.

    A bucket has ``fine[bucket]`` parts by its variates. A part that still is too large has a variate
    of many rows: it is cut into what comes before that variate, turns of its rows by their hash, and what comes
    after. Offsets are sums of sizes within a bucket; there are about as many slices as rows by ``slice_rows``.
    """
    folded = materialise(folded, "row-order")
    parts = F.get(_numbers(fine), F.col("__bucket"))
    share = F.col(variate) * buckets - F.col("__bucket")
    rows = folded.withColumn("__part", F.least(F.floor(share * parts), parts - 1))
    at = ["__bucket", "__part"]
    large = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 4 * slice_rows)
    often = rows.join(large.select(*at), at, "left_semi").groupBy(*at, variate).agg(F.count(F.lit(1)).alias("__rows"))
    often = often.groupBy(*at).agg(F.max_by(variate, "__rows").alias("__often"), F.max("__rows").alias("__rows"))
    often = materialise(often.select(*at, "__often", F.ceil(F.col("__rows") / slice_rows).cast("int").alias("__turns")), "often")
    # the hash as a place in [0, 1), in its own order
    place = F.col("__hash") / F.lit(2.0**64) + 0.5
    turn = (
        F.when(F.col("__often").isNull() | (F.col(variate) < F.col("__often")), 0)
        .when(F.col(variate) > F.col("__often"), F.col("__turns") + 1)
        .otherwise(F.least(F.floor(place * F.col("__turns")).cast("int"), F.col("__turns") - 1) + 1)
    )
    rows = rows.join(often, at, "left").withColumn("__turn", turn).drop("__often", "__turns")
    keys = [*at, "__turn"]
    sizes = rows.groupBy(*keys).agg(F.sum("__times").alias("__size"))
    before = Window.partitionBy("__bucket").orderBy("__part", "__turn").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", offset + F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    return rows.join(materialise(offsets, "offsets"), keys), keys


def holdout(df: DataFrame, share: float = 0.2, variate: str = "rand_num") -> tuple[DataFrame, DataFrame]:
    """Training rows (variate above ``share``) and validation rows (the rest)."""
    return df.where(F.col(variate) > share), df.where(F.col(variate) <= share)
