"""Spreading hot users over several join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featspan.session import shuffle_width

SALT = "__salt"
MIN_ROWS = 1000


def find_hot_users(instances: DataFrame, user: tuple[str, ...], min_rows: int = MIN_ROWS) -> DataFrame | None:
    """Users holding more than 1/(4 * shuffle width) of all instances, with a number of copies each.

    One small job over per-user counts tells whether there are any. If so they are fetched as
    a local table: fewer than 4 * width users can each hold more than that share, whatever
    the data, and their copies add up to less than 8 * width.
    """
    spark = instances.sparkSession
    per_user = instances.groupBy(*user).agg(F.count(F.lit(1)).alias("__rows"))
    total, most = per_user.agg(F.sum("__rows"), F.max("__rows")).first()
    share = max((total or 0) / (4 * shuffle_width(spark)), min_rows)
    if not most or most <= share:
        return None
    hot = per_user.where(F.col("__rows") > share).select(
        *user, F.ceil(F.col("__rows") / F.lit(float(share))).cast("int").alias("__copies")
    )
    return spark.createDataFrame(hot.collect(), hot.schema)


def spread(
    instances: DataFrame, history: DataFrame, hot: DataFrame, user: tuple[str, ...], by: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """Add a salt to both sides so that ``user + salt`` joins like ``user`` but without hot keys.

    Instances of a hot user are dealt out over its copies by a hash of ``by``; the history of
    that user (pre-aggregated by the caller) is repeated once per copy. ``hot`` comes from
    ``find_hot_users``, which bounds its size.
    """
    copies = F.coalesce(F.col("__copies"), F.lit(1))
    same = [F.col(f"l.{u}").eqNullSafe(F.col(f"h.{u}")) for u in user]
    marked = [
        df.alias("l").join(F.broadcast(hot.alias("h")), same, "left").select("l.*", "h.__copies")
        for df in (instances, history)
    ]
    dealt = marked[0].withColumn(SALT, F.pmod(F.xxhash64(*by), copies).cast("int"))
    repeated = marked[1].withColumn(SALT, F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.drop("__copies"), repeated.drop("__copies")


def heavy_keys(sides: list[DataFrame], keys: tuple[str, ...], min_rows: int = MIN_ROWS) -> list[dict[int, int]]:
    """Per side the hashes of keys with more than 1/(4 * shuffle width) of its rows, and a number of copies each.

    One pass over the key columns feeds a frequent-items sketch per side, which is merged without a
    shuffle of rows. There can be fewer than 4 * width such keys. A key the sketch misses by its error is
    only not spread.
    """
    spark = sides[0].sparkSession
    most = 4 * shuffle_width(spark)
    hashed = [df.select(F.lit(i).alias("__side"), key_hash(keys).alias("__hash")) for i, df in enumerate(sides)]
    union = hashed[0]
    for df in hashed[1:]:
        union = union.unionByName(df)
    tracked = min(max(16 * most, 4096), 1_000_000)
    sketch = union.where("__hash IS NOT NULL").groupBy("__side").agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(__hash, {min(most, tracked)}, {tracked})").alias("top")
    )
    out: list[dict[int, int]] = [{} for _ in sides]
    for row in sketch.collect():
        share = max(row["rows"] / most, min_rows)
        out[row["__side"]] = {t["item"]: -int(-t["count"] // share) for t in row["top"] if t["count"] > share}
    return out


def key_hash(keys: tuple[str, ...]) -> Column:
    """A 64-bit hash of a key; null where a part of it is null, as such keys match nothing."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return F.when(whole, F.xxhash64(*keys))


def copies_of(hashed: Column, heavy: dict[int, int]) -> Column:
    """The number of copies of a heavy key; null for others."""
    if not heavy:
        return F.lit(None).cast("int")
    listed = F.create_map(*[F.lit(x) for pair in sorted(heavy.items()) for x in pair])
    return F.try_element_at(listed, hashed)
