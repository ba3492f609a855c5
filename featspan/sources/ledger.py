"""The trial ledger: a Parquet folder with one partition per trial, written as a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featspan.operators.catalogue import column_name
from featspan.session import folder_exists

SCHEMA = (
    "trial int, task string, valid double, test double, valid_scores map<string,double>, "
    "test_scores map<string,double>, "
    "scheme array<struct<column:string,rule:string,method:string,parts:int>>, "
    "columns array<string>, splits array<struct<feature:string,splits:bigint>>, "
    "path array<string>, seconds double"
)
FIELDS = (
    "trial", "task", "valid", "test", "valid_scores", "test_scores", "scheme", "columns", "splits", "path", "seconds",
)
NODES = "tree bigint, id bigint, feature string, left bigint, right bigint, trial int"


class Ledger:
    """Store of trials; every question to it is a DataFrame.

    A trial's nodes are written first and its record last, each over whatever an attempt that was cut
    off left behind. The record is the commit: nodes without one are not seen. ``before`` shows the
    ledger as it was before that trial.
    """

    def __init__(self, spark: SparkSession, path: str, before: int | None = None):
        self.spark, self.path, self.before = spark, path, before

    def until(self, trial: int) -> Ledger:
        """The ledger as it was when ``trial`` began."""
        return Ledger(self.spark, self.path, trial)

    def claim(self, search: str) -> None:
        """Bind the ledger to a search: one that was begun with other settings cannot go on in it."""
        path = f"{self.path}/search"
        if folder_exists(self.spark, path):
            found = self.spark.read.schema("search string").parquet(path).first()
            if found and found["search"] != search:
                raise ValueError(f"{self.path} holds another search: {found['search']}, not {search}")
            if found:
                return
        self.spark.createDataFrame([(search,)], "search string").coalesce(1).write.mode("overwrite").parquet(path)

    def append(self, record: dict) -> None:
        """Commit a trial; one committed before under this number is replaced."""
        row = tuple(record[name] for name in FIELDS)
        one = self.spark.createDataFrame([row], SCHEMA).drop("trial").coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.path}/trials/trial={record['trial']}")

    def append_nodes(self, trial: int, nodes: DataFrame) -> None:
        nodes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/nodes/trial={trial}")

    def _read(self, name: str, schema: str, columns: list[str]) -> DataFrame:
        path = f"{self.path}/{name}"
        if not folder_exists(self.spark, path):
            return self.spark.createDataFrame([], schema).select(*columns)
        rows = self.spark.read.schema(schema).parquet(path).select(*columns)
        return rows if self.before is None else rows.where(F.col("trial") < self.before)

    def trials(self) -> DataFrame:
        return self._read("trials", SCHEMA, list(FIELDS))

    def nodes(self) -> DataFrame:
        """Nodes of all committed trials."""
        nodes = self._read("nodes", NODES, ["tree", "id", "feature", "left", "right", "trial"])
        return nodes.join(self.trials().select("trial"), "trial", "left_semi")

    def progress(self) -> tuple[int, float]:
        """The first trial that is missing, and the seconds that went into those before it."""
        rows = self.trials().select("trial", "seconds").collect()  # one row per trial
        seconds = {r["trial"]: r["seconds"] for r in rows}
        missing = next(i for i in range(len(seconds) + 1) if i not in seconds)
        return missing, max((seconds[i] for i in range(missing)), default=0.0)

    def long(self) -> DataFrame:
        """One row per trial and feature: scores, split count and scheme fields."""
        return long_form(self.trials())


def long_form(trials: DataFrame) -> DataFrame:
    """Explode trials (scheme, splits by feature name) to one row per feature."""
    items = trials.select("trial", "valid", "test", "splits", F.posexplode("scheme").alias("at", "item")).select(
        "trial", "valid", "test", "splits", "at", "item.*"
    )
    named = items.withColumn("feature", column_name())
    used = F.try_element_at(F.map_from_entries("splits"), F.col("feature"))
    return named.withColumn("splits", F.coalesce(used, F.lit(0)))
