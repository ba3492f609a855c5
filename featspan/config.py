"""Plain settings objects shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Rule names as they appear in a scheme.
ALL_RULE = "num_agg_all_gen"
PART_RULE = "num_agg_gen"
TS_RULE = "num_ts_gen"
RULES = (ALL_RULE, PART_RULE, TS_RULE)

# Methods of each rule, in catalogue order.
METHODS = {
    ALL_RULE: ("min", "max", "sum", "avg", "std", "count", "stddev"),
    PART_RULE: ("min", "max", "sum", "avg", "std", "count"),
    TS_RULE: ("min", "max", "sum", "avg", "std", "max_min", "max_day", "avg_day", "day_div_avg"),
}

# Fixed value: methods a hand-written scheme may use beyond the catalogue.
EXTRA_METHODS = {ALL_RULE: ("strmax",), PART_RULE: (), TS_RULE: ()}


@dataclass(frozen=True)
class Feature:
    """One derived feature: a log column, a rule, a method and (but for the 'all' rule) a window size."""

    column: str
    rule: str
    method: str
    parts: int | None = None

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"unknown rule {self.rule!r}")
        if self.method not in METHODS[self.rule] + EXTRA_METHODS[self.rule]:
            raise ValueError(f"rule {self.rule!r} has no method {self.method!r}")
        if (self.parts is None) != (self.rule == ALL_RULE):
            raise ValueError(f"rule {self.rule!r} and parts={self.parts!r} do not go together")

    @property
    def name(self) -> str:
        """Name of the generated column."""
        if self.rule == ALL_RULE:
            return f"{self.column}_{self.method}"
        suffix = "p" if self.rule == PART_RULE else "ts"
        return f"{self.column}_{self.parts}{suffix}_{self.method}"

    @classmethod
    def of(cls, item) -> "Feature":
        """Accept a Feature, a Row/dict with these fields, or ``[column, rule, [method, parts, friend]]``."""
        if isinstance(item, cls):
            return item
        if hasattr(item, "asDict"):
            item = item.asDict()
        if isinstance(item, dict):
            return cls(item["column"], item["rule"], item["method"], item["parts"])
        column, rule, params = item
        method, parts = params[0], params[1] if len(params) > 1 else None
        return cls(column, rule, method, parts)

    def as_list(self) -> list:
        return [self.column, self.rule, [self.method, self.parts, None]]


@dataclass(frozen=True)
class Layout:
    """Column roles of the instance table and the log.

    ``tie`` orders rows of the same day (largest is latest); empty means all remaining
    log columns. Days may be dates, timestamps or yyyyMMdd integers. The two flags state
    constraints the caller vouches for and only remove work.
    """

    user: tuple[str, ...] = ("ID",)
    first: str | None = "first_timestep"
    last: str = "last_timestep"
    day: str = "timestep"
    tie: tuple[str, ...] = ()
    carry: tuple[str, ...] = ("label", "rand_num", "row_num")
    one_row_per_day: bool = False
    one_instance_per_user: bool = False

    @property
    def instance(self) -> tuple[str, ...]:
        return (*self.user, *((self.first,) if self.first else ()), self.last)

    def with_(self, **changes) -> "Layout":
        return replace(self, **changes)


@dataclass(frozen=True)
class TaskConfig:
    """What is being predicted and how instances and days are split."""

    name: str = "public_user"
    task: str = "01-Class"  # 01-Class | Multi-Class | Regression
    layout: Layout = field(default_factory=Layout)
    train_rows: tuple[int, int] | None = None  # closed ranges; None is all rows or days
    test_rows: tuple[int, int] | None = None
    train_days: tuple | None = None
    test_days: tuple | None = None
    horizon: int = 819
    direction: str = "right"
    boost_rounds: int = 10
    subsample: float = 1.0
    column_share: float = 0.7
    depth: int = 6
    step: float = 0.05
    positive_weight: float = 2.0
    patience: int | None = None  # rounds without gain on the held-out rows before boosting ends; None: all rounds
    holdout: float = 0.2
    seed: int = 2023


# Row and day ranges of the shipped task, for TaskConfig(**SHIPPED_RANGES).
SHIPPED_RANGES = {
    "train_rows": (1, 500000),
    "test_rows": (500001, 970960),
    "train_days": (20150101, 20170331),
    "test_days": (20150101, 20170331),
}


@dataclass(frozen=True)
class SearchConfig:
    """Budget and selectors of a search."""

    rounds: int = 200
    time_limit: float = 18000.0
    n_features: int = 10
    top_k: int = 5
    metrics: tuple[str, ...] = ("Acc",)
    seed: int = 0
    # guided search only
    init_rounds: int = 1
    selectors: tuple[str, ...] = (
        "best_scheme_sample",
        "imp_filter",
        "tree_path",
        "pair_path",
        "random_generation",
    )
    pool: int = 1000
    neg_num: int = 2
    path_steps: int = 50
