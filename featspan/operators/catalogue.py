"""The space of candidate features: window grid, rules, candidates, integer codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from featspan.config import ALL_RULE, METHODS, PART_RULE, RULES, TS_RULE, Feature, Layout

TYPE = "all_feats"  # fixed value: the only meaning type of a feature column
NAME_SUFFIX = {PART_RULE: "p", TS_RULE: "ts"}
SCHEME_SCHEMA = "column string, rule string, method string, parts int"


def feature_columns(log: DataFrame, layout: Layout = Layout()) -> list[str]:
    """Log columns that carry a feature: neither instance key, user key nor day."""
    keys = {*layout.instance, *layout.user, layout.day, *layout.tie}
    return [c for c in log.columns if c not in keys]


def string_columns(log: DataFrame, layout: Layout = Layout()) -> list[str]:
    return [c for c in feature_columns(log, layout) if isinstance(log.schema[c].dataType, T.StringType)]


def grid_step(horizon: int) -> int:
    """Windows go in tens below a horizon of 1000 and in hundreds from there on."""
    return 10 if horizon < 1000 else 100


def parts_grid(horizon: int) -> list[int]:
    """Window sizes in parts up to the horizon; an empty grid is an error."""
    step = grid_step(horizon)
    if horizon < step:
        raise ValueError(f"horizon {horizon} is below the smallest window")
    return list(range(step, horizon + 1, step))


def with_grid(df: DataFrame, horizon: str, name: str = "parts") -> DataFrame:
    """One row per window size of each row's own horizon; rows below the smallest window get none."""
    step = F.when(F.col(horizon) < 1000, 10).otherwise(100)
    sizes = F.when(F.col(horizon) >= step, F.sequence(step, F.col(horizon).cast("int"), step))
    return df.withColumn(name, F.explode(sizes))


def rule_catalogue(spark: SparkSession, grid: list[int]) -> DataFrame:
    """Rules with their methods, window sizes and name patterns."""
    # Name patterns.
    patterns = {ALL_RULE: "{feat}_{method}", PART_RULE: "{feat}_{parts}p_{method}", TS_RULE: "{feat}_{parts}ts_{method}"}
    rows = [
        (i, rule, list(METHODS[rule]), None if rule == ALL_RULE else list(grid), patterns[rule])
        for i, rule in enumerate(RULES)
    ]
    return spark.createDataFrame(
        rows, "rule_order int, rule string, methods array<string>, parts array<int>, pattern string"
    )


def column_name():
    """Generated column name from (column, rule, method, parts)."""
    suffix = F.when(F.col("rule") == PART_RULE, NAME_SUFFIX[PART_RULE]).otherwise(NAME_SUFFIX[TS_RULE])
    sized = F.concat(F.col("column"), F.lit("_"), F.col("parts").cast("string"), suffix, F.lit("_"), F.col("method"))
    return F.when(F.col("rule") == ALL_RULE, F.concat_ws("_", "column", "method")).otherwise(sized)


def candidates_of(columns: DataFrame, grid: list[int]) -> DataFrame:
    """Every candidate feature of the given columns (column, n_columns), with its draw weight.

    The rules ride along as literal arrays on each column row, so nothing is joined.
    ``weight`` is the chance of a candidate in a draw that picks column, rule, method and
    window size in turn, each evenly.
    """
    sized = ", ".join(str(p) for p in grid)
    structs = []
    for rule in RULES:
        methods = ", ".join(f"'{m}'" for m in METHODS[rule])
        sizes = "array(cast(null as int))" if rule == ALL_RULE else f"array({sized})"
        n = len(METHODS[rule]) * (1 if rule == ALL_RULE else len(grid))
        structs.append(f"named_struct('rule', '{rule}', 'methods', array({methods}), 'sizes', {sizes}, 'n', {n})")
    out = columns.selectExpr("column", "n_columns", f"inline(array({', '.join(structs)}))")
    out = out.withColumn("method", F.explode("methods")).withColumn("parts", F.explode("sizes"))
    weight = F.lit(1.0) / (F.col("n_columns") * len(RULES) * F.col("n"))
    return out.select(
        "column", "rule", "method", "parts", column_name().alias("feature"), weight.alias("weight"), "n_columns"
    )


def candidates_for(spark: SparkSession, log: DataFrame, horizon: int, layout: Layout = Layout()) -> DataFrame:
    """Candidates of a log."""
    names = feature_columns(log, layout)
    columns = spark.createDataFrame([(c, len(names)) for c in names], "column string, n_columns int")
    return candidates_of(columns, parts_grid(horizon))


@dataclass(frozen=True)
class CodeBooks:
    """Integer codes in catalogue order; 0 stands for 'None'."""

    values: dict[str, tuple[str, ...]]

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        rows = [("None", 0)] + [(x, i) for i, x in enumerate(self.values[name], 1)]
        return spark.createDataFrame(rows, "value string, code int")

    def size(self, name: str) -> int:
        """Largest code."""
        return len(self.values[name])


def code_books(columns: list[str], grid: list[int]) -> CodeBooks:
    """Codes of columns, types, rules, methods and window sizes."""
    methods = dict.fromkeys(m for rule in RULES for m in METHODS[rule])
    listed = {"feat": columns, "type": [TYPE], "rule": RULES, "meth": methods, "day": grid}
    return CodeBooks({name: tuple(str(x) for x in values) for name, values in listed.items()})


def encode(schemes: DataFrame, books: CodeBooks) -> DataFrame:
    """Add the six integer codes of each scheme row. Code books are no longer than the catalogue."""
    keys = {
        "feat": F.col("column"),
        "type": F.lit(TYPE),
        "rule": F.col("rule"),
        "meth": F.col("method"),
        "day": F.coalesce(F.col("parts").cast("string"), F.lit("None")),
        "friend": F.lit("None"),
    }
    out = schemes
    for name, key in keys.items():
        book = books.frame(schemes.sparkSession, "meth" if name == "friend" else name)
        codes = book.select(F.col("value").alias("__value"), F.col("code").alias(f"{name}_code"))
        out = out.withColumn("__key", key).join(codes, F.col("__key") == F.col("__value"), "left")
        out = out.drop("__key", "__value")
    return out


def scheme_frame(spark: SparkSession, scheme) -> DataFrame:
    """A scheme list as a table, in order."""
    rows = [(i, f.column, f.rule, f.method, f.parts, f.name) for i, f in enumerate(map(Feature.of, scheme))]
    return spark.createDataFrame(rows, f"position int, {SCHEME_SCHEMA}, feature string")
