"""Session helpers: shuffle width, the shared work folder, materialising a frame once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without it, and then gets a folder of its own. Inside ``written_to``
    and ``scratch`` it is the folder of the innermost block.
    """
    blocks = _blocks(spark)
    if blocks:
        return blocks[-1]
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = getattr(spark, "_featspan_work_dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="featspan-", dir="/tmp")
        spark._featspan_work_dir = folder
    return folder


def _blocks(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_featspan_blocks"):
        context._featspan_blocks = []
    return context._featspan_blocks


@contextmanager
def written_to(spark: SparkSession, path: str) -> Iterator[str]:
    """Inside the block ``path`` is the work folder."""
    blocks = _blocks(spark)
    blocks.append(path)
    try:
        yield path
    finally:
        blocks.remove(path)


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A work folder for the block, removed with it; no frame that reads from it may be used afterwards."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        with written_to(spark, path):
            yield path
    finally:
        remove_folder(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage, survives lost executors, and leaves later reads column pruned.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, by: tuple[str, ...], order: tuple[str, ...] = ()) -> str:
    """Write ``df`` to the shared folder as a table bucketed by ``by``, one sorted file per bucket.

    Joins and windows on ``by`` then read it without a shuffle. There are as many buckets as
    shuffle partitions, so the other side of a join is shuffled to match. Returns the table's name.
    """
    spark = df.sparkSession
    width, table = shuffle_width(spark), f"featspan_{name}_{uuid.uuid4().hex}".replace("-", "_")
    (
        df.repartition(width, *by)
        .write.bucketBy(width, *by)
        .sortBy(*by, *order)
        .option("path", f"{work_dir(spark)}/{table}")
        .saveAsTable(table)
    )
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, by the file system its path names; nothing happens if it is gone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table this library wrote into the shared folder, and its files."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    for row in rows:
        remove_folder(spark, row.data_type)
