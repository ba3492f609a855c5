"""Scalar rules used all over: null filling, safe differences and ratios, token counts, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def fill_zero(df: DataFrame, value: float = 0) -> DataFrame:
    """NULL and NaN of every numeric column become ``value``."""
    return df.na.fill(value)


def as_feature(df: DataFrame, name: str) -> Column:
    """A log column as the double the aggregates run on: 32-bit precision, no NULL, no NaN."""
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        col = col.try_cast("float")
    else:
        col = col.cast("float")
    wide = col.cast("double")
    return F.coalesce(F.nanvl(wide, F.lit(0.0)), F.lit(0.0))


def diff_or_zero(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.coalesce(a, zero) - F.coalesce(b, zero)


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b where a missing a is 0, a missing b is 0.01 (fixed value) and a zero b gives 0."""
    quotient = F.try_divide(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.01)))
    return F.coalesce(quotient, F.lit(0.0))


def token_count(col: Column | str) -> Column:
    """Number of comma-separated tokens; 0 for NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), 0).otherwise(F.size(F.split(c, ",")))


def unit_hash(*cols: Column | str, salt: str = "") -> Column:
    """Deterministic variate in [0, 1) from the md5 of the columns and a salt (52 bits)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in parts])
    digest = F.md5(F.concat(text, F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
