"""Raw tables: schemas and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column names of the four raw tables. Days are yyyyMMdd integers.
TRANSACTIONS = (
    "msno string, transaction_date int, payment_method_id int, payment_plan_days int, plan_list_price int, "
    "actual_amount_paid int, is_auto_renew int, is_cancel int, membership_expire_date int"
)
USAGE = (
    "msno string, date int, num_25 int, num_50 int, num_75 int, num_985 int, num_100 int, num_unq int, "
    "total_secs double"
)
MEMBERS = "msno string, city int, bd int, registered_via int"
LABELS = "msno string, is_churn int"


def read_table(
    spark: SparkSession, paths: str | list[str], schema: str | None, columns: list[str] | None = None
) -> DataFrame:
    """Read one or many files or globs of one table, as CSV with a header or as Parquet.

    CSV files are matched to ``schema`` by header name, so column order may differ from file to
    file; without a schema it is inferred, which costs a pass over the data.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if any(p.rstrip("/").endswith((".parquet", ".parq")) for p in paths):
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(*paths)
    else:
        reader = spark.read.option("header", True)
        if schema:
            reader = reader.schema(schema).option("enforceSchema", False)
        else:
            reader = reader.option("inferSchema", True)
        df = reader.csv(paths)
    return df.select(*columns) if columns else df


def union_logs(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of log parts that may come from several places."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
