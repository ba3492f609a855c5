"""Evaluate a scheme: generate features, fit on training rows, score held-out and test rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from featspan.config import Feature, TaskConfig
from featspan.functions.days import as_day
from featspan.operators.catalogue import feature_columns
from featspan.operators.generate import DayTable, generate, lineage_frame, prepare_days
from featspan.operators.ingest import slice_tables
from featspan.operators.learn import design_matrix, fit, node_table, score, shuffled
from featspan.operators.metrics import REGRESSION, metrics
from featspan.operators.rownum import holdout
from featspan.operators.skew import find_hot_users
from featspan.session import drop_table, materialise, materialise_bucketed, remove_folder, scratch, work_dir, written_to


@dataclass(frozen=True)
class Part:
    """Training or test side of a task, as written: instances, day partials, the log rows of days
    with several rows (the only ones a scheme still needs), and hot users if any."""

    instances: DataFrame
    log: DataFrame
    days: DayTable
    hot: DataFrame | None


@dataclass(frozen=True)
class TaskData:
    """Tables of a task, written once for all rounds."""

    config: TaskConfig
    train: Part
    test: Part
    folder: str

    def close(self) -> None:
        """Remove the tables and their files."""
        spark = self.train.instances.sparkSession
        for name in {self.train.days.table, self.test.days.table} - {None}:
            drop_table(spark, name)
        remove_folder(spark, self.folder)


@dataclass(frozen=True)
class Outcome:
    """What a trial yields: scores, matrix columns in model order, lineage and the model."""

    valid: float
    valid_scores: dict
    test: float
    test_scores: dict
    columns: list[str]
    lineage: dict
    model: object


def prepare(instances: DataFrame, log: DataFrame, config: TaskConfig) -> TaskData:
    """Cut out training and test tables and write what every round reads.

    The day partials, by far the largest of them, are bucketed by user, so that a round shuffles
    instances only. The log itself is not copied.
    """
    folder = f"{work_dir(instances.sparkSession)}/task-{uuid.uuid4().hex}"
    with written_to(instances.sparkSession, folder):
        return _prepare(instances, log, config, folder)


def _prepare(instances: DataFrame, log: DataFrame, config: TaskConfig, folder: str) -> TaskData:
    layout = config.layout
    # row numbers and splits come from one written table; both sides only filter it
    instances = materialise(instances, "instances")
    train, train_log = slice_tables(instances, log, config.train_rows, config.train_days, layout)
    test, test_log = slice_tables(instances, log, config.test_rows, config.test_days, layout)
    train_rows, train_days = _reduce(train_log, config, "train")
    test_rows, test_days = train_rows, train_days
    if config.train_days != config.test_days:
        test_rows, test_days = _reduce(test_log, config, "test")

    def part(frame: DataFrame, rows: DataFrame, days: DayTable) -> Part:
        hot = None if layout.one_instance_per_user else find_hot_users(frame, layout.user)
        return Part(frame, rows, days, hot)

    return TaskData(config, part(train, train_rows, train_days), part(test, test_rows, test_days), folder)


def _reduce(log: DataFrame, config: TaskConfig, name: str) -> tuple[DataFrame, DayTable]:
    """Day partials of a log, and its rows on days that have several."""
    layout = config.layout
    table = prepare_days(log, feature_columns(log, layout), layout)
    spark = log.sparkSession
    stored = materialise_bucketed(table.frame, f"{name}_days", layout.user, ("__day",))
    frame = spark.table(stored)
    crowded = frame.where("__n > 1").select(*layout.user, "__day")
    if crowded.isEmpty():
        return log, DayTable(frame, table.columns, True, stored)
    rows = log.withColumn("__day", as_day(log, layout.day)).join(crowded, [*layout.user, "__day"], "left_semi")
    return materialise(rows.drop("__day"), f"{name}-rows"), DayTable(frame, table.columns, False, stored)


def features_of(data: TaskData, scheme, side: str = "train") -> tuple[DataFrame, dict]:
    config, part = data.config, getattr(data, side)
    return generate(
        part.instances, part.log, scheme, config.layout, direction=config.direction, days=part.days, hot=part.hot
    )


def train_matrix(data: TaskData, scheme, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(label, features) of all training rows, and the lineage of the entries of ``features``.

    The lineage has a row per entry: feature, its scheme fields, position in the scheme, and place in the
    vector, from 0.
    """
    table, lineage = features_of(data, scheme)
    columns = shuffled(list(lineage), seed)
    places = {name: i for i, name in enumerate(columns)}
    frame = lineage_frame(table.sparkSession, lineage)
    at = F.create_map(*[F.lit(x) for pair in places.items() for x in pair]) if places else F.create_map()
    return design_matrix(table, columns), frame.withColumn("place", F.try_element_at(at, F.col("feature")))


def evaluate(data: TaskData, scheme, names=("Acc",), seed: int = 0) -> Outcome:
    """One trial. Only the scores reach the driver.

    The training matrix is written for the trial. Every pass of the fit sends the plan its rows come from to
    each of its tasks: read back, that is a scan in splits that follow the matrix, not the whole of
    ``generate`` in a task per bucket.
    """
    config = data.config
    scheme = [Feature.of(f) for f in scheme]
    table, lineage = features_of(data, scheme)
    columns = shuffled(list(lineage), seed)
    with scratch(table.sparkSession, "trial"):
        matrix = materialise(design_matrix(table, columns, keep=("rand_num",)), "matrix")
        train, valid = holdout(matrix, config.holdout)
        model = fit(train.drop("rand_num"), config, valid.drop("rand_num"))
        valid_scores = _scores(model, valid, names, config)
    test_table, _ = features_of(data, scheme, "test")
    test_scores = _scores(model, design_matrix(test_table, columns), names, config)
    return Outcome(
        sum(valid_scores.values()), valid_scores, sum(test_scores.values()), test_scores, columns, lineage, model
    )


def _scores(model, matrix: DataFrame, names, config: TaskConfig) -> dict[str, float]:
    scored = score(model, matrix, config.task)
    if config.task == REGRESSION:
        return dict.fromkeys(names, 0.0)
    found = metrics(scored, names, config.task).first()["scores"]
    return {n: float(found[n]) if found[n] is not None else 0.0 for n in names}


def outcome_nodes(outcome: Outcome, spark) -> DataFrame:
    return node_table(outcome.model, spark, outcome.columns)
