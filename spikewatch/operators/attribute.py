"""Findings (F2, A8, A10), most specific slice per period (W7), report order
(A9, O0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q, rule_names
from ..spec import AnalysisSpec
from .order import numbered


def _flag(df: DataFrame, name: str):
    return name if name in df.columns else None


def with_rule_names(detected: DataFrame) -> DataFrame:
    """The names of the rules that fired, in the order z_score, metric,
    change (count for the EDA profile)."""
    return detected.withColumn("anomaly_types", rule_names(
        _flag(detected, "is_outlier_z"), _flag(detected, "is_outlier_metric"),
        _flag(detected, "change_point"), _flag(detected, "is_outlier_count")))


def findings(detected: DataFrame) -> DataFrame:
    """F2 + A8: flagged (slice, period) rows with the names of the rules that
    fired.  ``is_outlier`` NULL is not a finding."""
    return with_rule_names(detected.filter(F.col("is_outlier")))


def most_specific(found: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Per period keep the slice with the most keys, then the highest
    total, then the earliest subset.  Also records ``first_ordinal``: the
    earliest subset that flagged the period, the report's tie-break.

    One aggregate per period (``max_by`` over those three and the smallest
    ordinal), combined before the shuffle, so of a period's findings at most one
    per map task travels."""
    t = spec.time_col
    row = ", ".join(q(c) for c in found.columns if c != t)
    picked = found.groupBy(t).agg(F.expr(f"max_by(struct({row}), struct(n_keys, total_metric, -slice_ordinal)) AS _best"),
                                  F.min("slice_ordinal").alias("first_ordinal"))
    return picked.select(*[F.col(q(t)) if c == t else F.col(f"_best.{q(c)}") for c in found.columns], "first_ordinal")


def report_order(spec: AnalysisSpec):
    """O0: total cost descending, then discovery order (first subset that
    flagged the period, then time)."""
    return [F.col("total_metric").desc(), F.col("first_ordinal").asc(), F.col(spec.time_col).asc()]


def ranked_findings(selected: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Numbers the selected findings in report order (``report_rank`` from 1)
    and adds ``n_blocks``.  The findings are range-sorted once over all tasks
    and written to the checkpoint folder; ranks come from the counts per range
    (``order.numbered``)."""
    placed = numbered(selected, report_order(spec), "_place", total="n_blocks")
    return placed.selectExpr("* EXCEPT (_place, n_blocks)", "CAST(_place + 1 AS INT) AS report_rank", "n_blocks")
