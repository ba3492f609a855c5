"""Tables and folders in the shared folder, and sizes that follow the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featspan.session import materialise, shuffle_width, work_dir

__all__ = ["blocks_for", "materialise", "new_folder", "shuffle_width", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def blocks_for(df: DataFrame, column: str, size: int) -> int:
    """How many blocks of about ``size`` bytes of ``column`` the rows fill; one scan of that column."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // size))
