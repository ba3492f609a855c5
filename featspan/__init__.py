"""Feature generation and feature search over user event logs, on Spark DataFrames."""

from featspan.config import Feature, Layout, SearchConfig, TaskConfig

__all__ = ["Feature", "Layout", "SearchConfig", "TaskConfig"]
