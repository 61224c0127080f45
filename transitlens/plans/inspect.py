"""Plan inspection helpers (used by the plan tests and handy in a notebook)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Physical operators that mean rows leave the JVM for a Python worker.
PYTHON_NODES = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "MapInArrow",
    "PythonMapInArrow",
    "FlatMapGroupsInPandas",
    "FlatMapCoGroupsInPandas",
    "AggregateInPandas",
    "WindowInPandas",
    "PythonUDF",
)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints, returned instead of printed."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def python_nodes(df: DataFrame) -> list[str]:
    text = plan_text(df)
    return [name for name in PYTHON_NODES if name in text]


def scan_count(df: DataFrame) -> int:
    """Number of file scans in the physical plan (cached relations not counted)."""
    return len(re.findall(r"^\(\d+\) Scan (?!In)", plan_text(df), flags=re.M))


def scan_fields(df: DataFrame, field: str) -> list[str]:
    """Values of a scan property (``PushedFilters``, ``PartitionFilters``, ``ReadSchema``)."""
    return re.findall(rf"^{field}: (.*)$", plan_text(df), flags=re.M)
