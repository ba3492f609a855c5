"""Raw tables -> feature log and label instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featspan.config import Layout, TaskConfig
from featspan.functions.days import left_days
from featspan.functions.scalars import fill_zero
from featspan.operators.rownum import global_row_number
from featspan.operators.skew import MIN_ROWS, SALT, copies_of, heavy_keys, key_hash, spread


def transaction_features(transactions: DataFrame) -> DataFrame:
    """(ID, timestep, f1..f7) of the payment table; f7 is the days left until the membership ends."""
    # Which raw column becomes which feature.
    df = transactions.select(
        F.col("msno").alias("ID"),
        F.col("transaction_date").alias("timestep"),
        F.col("payment_method_id").alias("f1"),
        F.col("payment_plan_days").alias("f2"),
        F.col("plan_list_price").alias("f3"),
        F.col("actual_amount_paid").alias("f4"),
        F.col("is_auto_renew").alias("f5"),
        F.col("is_cancel").alias("f6"),
        left_days("membership_expire_date", "transaction_date").alias("f7"),
    )
    return fill_zero(df)


def usage_features(usage: DataFrame) -> DataFrame:
    """(ID, timestep, f8..f14) of the usage log."""
    names = ["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"]
    df = usage.select(
        F.col("msno").alias("ID"),
        F.col("date").alias("timestep"),
        *[F.col(n).alias(f"f{i}") for i, n in enumerate(names, 8)],
    )
    return fill_zero(df)


def member_features(members: DataFrame) -> DataFrame:
    """(ID, f15..f17) of the member table."""
    df = members.select(
        F.col("msno").alias("ID"),
        F.col("city").alias("f15"),
        F.col("bd").alias("f16"),
        F.col("registered_via").alias("f17"),
    )
    return fill_zero(df)


def outer_merge(
    left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("ID", "timestep"), min_rows: int = MIN_ROWS
) -> DataFrame:
    """Full outer join on user and day, keys coalesced. Rows of a day that has several stay several.

    Each side is read and shuffled once. Spark cannot split a skewed key of a full outer join, so a
    sketch of the keys tells the heavy ones first. Their rows on the heavy side (the left one, if both
    are) are dealt to copies of the key by a hash of the row, and the other side's are repeated per copy.
    In a copy that got none of the heavy side's rows the repeated ones look unmatched; as the key does
    have rows on the heavy side, they are dropped.
    """
    keys = list(on)
    heavy_left, heavy_right = heavy_keys([left, right], on, min_rows)
    heavy_right = {k: n for k, n in heavy_right.items() if k not in heavy_left}
    if not heavy_left and not heavy_right:
        return left.join(right, keys, "full_outer")

    def salted(df: DataFrame, dealt: dict[int, int], repeated: dict[int, int], mark: str) -> DataFrame:
        key = key_hash(on)
        deal, again = copies_of(key, dealt), copies_of(key, repeated)
        salts = F.when(deal.isNotNull(), F.array(F.pmod(F.xxhash64(*df.columns), deal).cast("int")))
        salts = salts.when(again.isNotNull(), F.sequence(F.lit(0), again - 1)).otherwise(F.array(F.lit(0)))
        return df.select("*", F.lit(True).alias(mark), F.explode(salts).alias(SALT))

    both = salted(left, heavy_left, heavy_right, "__left").join(
        salted(right, heavy_right, heavy_left, "__right"), [*keys, SALT], "full_outer"
    )
    key = key_hash(on)
    spurious = (copies_of(key, heavy_left).isNotNull() & F.col("__left").isNull()) | (
        copies_of(key, heavy_right).isNotNull() & F.col("__right").isNull()
    )
    return both.where(~spurious).drop("__left", "__right", SALT)


def attach_static(
    log: DataFrame,
    static: DataFrame,
    user: tuple[str, ...] = ("ID",),
    by: tuple[str, ...] = ("timestep",),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Repeat per-user attributes on every log row.

    Whether to broadcast is left to Spark's size estimate, and splitting a skewed log to its skew
    join; no job runs here. Rows of users given as ``hot`` are dealt out by the ``by`` columns, the
    attributes of those users repeated.
    """
    if hot is None:
        return log.join(static, list(user), "left")
    rows, repeated = spread(log, static, hot, user, by)
    return rows.join(repeated, [*user, SALT], "left").drop(SALT)


def build_log(transactions: DataFrame, usage: DataFrame, members: DataFrame) -> DataFrame:
    """The feature log (ID, timestep, f1..f17)."""
    activity = outer_merge(usage_features(usage), transaction_features(transactions))
    log = attach_static(activity, member_features(members))
    return fill_zero(log.select("ID", "timestep", *[f"f{i}" for i in range(1, 18)]))


def first_last(log: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """First and last day of each user."""
    return log.groupBy(*layout.user).agg(
        F.min(layout.day).alias("first_timestep"), F.max(layout.day).alias("last_timestep")
    )


def build_instances(labels: DataFrame, log: DataFrame, salt: str = "", layout: Layout = Layout()) -> DataFrame:
    """One instance per label row: (ID, label, first, last, rand_num, row_num).

    Users without log rows get 0 as first and last day when days are integers, NULL when they
    are dates.
    """
    folded = labels.groupBy(*labels.columns).agg(F.count(F.lit(1)).alias("__times"))
    spans = fill_zero(folded.join(first_last(log, layout), list(layout.user), "left"))
    return global_row_number(spans, (*layout.user, "label"), salt=salt, times="__times")


def labels_of(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("msno").alias("ID"), F.col("is_churn").alias("label"))


def slice_tables(
    instances: DataFrame, log: DataFrame, row_range: tuple | None, day_range: tuple | None, layout: Layout = Layout()
) -> tuple[DataFrame, DataFrame]:
    """Closed range of instance row numbers and closed range of log days; None takes all."""
    rows = instances if row_range is None else instances.where(F.col("row_num").between(*row_range))
    days = log if day_range is None else log.where(F.col(layout.day).between(*day_range))
    return fill_zero(rows), fill_zero(days)


def train_tables(instances: DataFrame, log: DataFrame, task: TaskConfig) -> tuple[DataFrame, DataFrame]:
    return slice_tables(instances, log, task.train_rows, task.train_days, task.layout)


def test_tables(instances: DataFrame, log: DataFrame, task: TaskConfig) -> tuple[DataFrame, DataFrame]:
    return slice_tables(instances, log, task.test_rows, task.test_days, task.layout)
