"""Screening: per-value anomaly counts (A4) and the top value per dimension."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SCREEN, AnalysisSpec, RuleSet
from .rules import detect
from .series import value_totals

VALUE_KEYS = ("variable", "value")


def value_series(df: DataFrame, spec: AnalysisSpec, rules: RuleSet = SCREEN,
                 block_rows: Optional[int] = None) -> DataFrame:
    """Per-value series of every test column with the screening rules applied.
    Window partitions are (variable, value): one task per value series (or
    per block of one, with ``block_rows``)."""
    return detect(value_totals(df, spec), spec, rules, key_cols=VALUE_KEYS, block_rows=block_rows)


def anomaly_counts(screened: DataFrame) -> DataFrame:
    """A4: flagged periods per (variable, value); NULL flags do not count and a
    value with no flag at all gets 0.  ``screened`` is already partitioned by
    (variable, value), so this aggregate adds no shuffle."""
    return screened.groupBy(*VALUE_KEYS).agg(
        F.coalesce(F.sum(F.col("is_outlier").cast("int")), F.lit(0)).cast("bigint").alias("anomaly_count"),
    )


def top_values(counts: DataFrame) -> DataFrame:
    """The value with the most flagged periods per variable; ties go to the
    smallest value (string order).  NULL values are never picked.  At most one
    row per test column, which is what makes it safe to broadcast later."""
    w = Window.partitionBy("variable").orderBy(F.col("anomaly_count").desc(), F.col("value").asc())
    return (
        counts.filter(F.col("value").isNotNull())
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
