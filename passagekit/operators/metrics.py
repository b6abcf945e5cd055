"""Counts that ride along with a write, previews and corpus statistics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_metrics(df: DataFrame, stage: str, rows: Column | None = None) -> tuple[DataFrame, Observation]:
    """Count the rows of a stage (or sum `rows`) while a later action runs; read it with `observation.get["rows"]`."""
    observation = Observation(stage)
    counted = F.count(F.lit(1)) if rows is None else F.coalesce(F.sum(rows), F.lit(0))
    return df.observe(observation, counted.alias("rows")), observation


def timed(action: Callable[[], object], *observations: Observation) -> dict[str, float]:
    """Run one action; its seconds and the row count of every observed stage."""
    start = time.perf_counter()
    action()
    report: dict[str, float] = {"seconds": round(time.perf_counter() - start, 2)}
    for observation in observations:
        report[str(observation._name)] = observation.get["rows"]
    return report


def preview(df: DataFrame, n: int = 1) -> DataFrame:
    """The first n rows."""
    return df.limit(n)


def corpus_statistics(rows: DataFrame, group: str = "source", text_col: str = "text") -> DataFrame:
    """Rows and characters per group."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(text_col)).alias("chars"))
