"""Chart-ready tables.

The reference draws these with matplotlib on the driver; here they are plain
DataFrames a plotting front end can read: bands around the rolling mean,
classified anomaly points on the unsliced series, overlay series in long
format, and the EDA flag filters.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EDA_POINT_COLORS, EDA_POINT_LABELS, point_class_sql, point_color_sql, point_label_sql, q
from ..operators.attribute import findings, with_rule_names
from ..operators.lattice import slice_columns
from ..spec import AnalysisSpec, RuleSet


def bands(series: DataFrame, rules: RuleSet, width: float | None = None) -> DataFrame:
    """O1: acceptable band ``rolling_mean -/+ width * rolling_std`` (width
    defaults to the rule set's z cut)."""
    w = float(width if width is not None else rules.z_cut)
    return series.withColumns({
        "lower_bound": F.col("rolling_mean") - F.lit(w) * F.col("rolling_std"),
        "upper_bound": F.col("rolling_mean") + F.lit(w) * F.col("rolling_std"),
    })


def chart_points(selected: DataFrame, base: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """J2 + O5: each reported period placed on the unsliced series, with its
    point class (a rule name or ``multiple``), legend label and colour.  Both
    sides hold at most one row per period; Spark picks the join strategy from
    their measured sizes."""
    t = spec.time_col
    pts = selected.selectExpr(q(t), "slice_key", "anomaly_types",
                              f"{point_class_sql('anomaly_types')} AS point_class")
    out = base.select(t, "total_metric").join(pts, t, "inner")
    return out.selectExpr("*", f"{point_label_sql('point_class')} AS label",
                          f"{point_color_sql('point_class')} AS color")


def lattice_points(detected: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """``chart_points`` straight from the detected lattice, whose subset 0 is the
    unsliced series: one aggregate per period picks the finding (W7) and the
    total to place it at, without a join or a second reading."""
    t = q(spec.time_col)
    flagged = detected.filter(F.col(spec.time_col).isNotNull() & (F.col("is_outlier") | (F.col("slice_ordinal") == 0)))
    best = "max_by(struct(slice_key, anomaly_types), struct(n_keys, total_metric, -slice_ordinal)) FILTER (WHERE is_outlier)"
    out = with_rule_names(flagged).groupBy(spec.time_col).agg(
        F.expr("max(total_metric) FILTER (WHERE slice_ordinal = 0)").alias("total_metric"), F.expr(best).alias("_best"))
    return out.filter("_best IS NOT NULL").selectExpr(
        t, "total_metric", "_best.slice_key", "_best.anomaly_types", f"{point_class_sql('_best.anomaly_types')} AS point_class").selectExpr(
        "*", f"{point_label_sql('point_class')} AS label", f"{point_color_sql('point_class')} AS color")


def reported_axis(base: DataFrame, selected: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The unsliced series with ``is_reported`` marking the axis ticks."""
    t = spec.time_col
    marks = selected.select(F.col(t), F.lit(True).alias("is_reported"))
    return base.join(marks, t, "left").withColumn(
        "is_reported", F.coalesce(F.col("is_reported"), F.lit(False)))


def lattice_axis(detected: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """``reported_axis`` straight from the detected lattice: one aggregate per
    period keeps the unsliced row and whether any slice was flagged."""
    drop = {*slice_columns(spec), spec.time_col}
    base = [c for c in detected.columns if c not in drop]
    out = detected.groupBy(spec.time_col).agg(
        F.expr(f"any_value(struct({', '.join(q(c) for c in base)})) FILTER (WHERE slice_ordinal = 0) AS _base"),
        F.expr("coalesce(bool_or(is_outlier), false) AS _any"))
    return out.select(spec.time_col, *[F.col(f"_base.{q(c)}") for c in base], F.lit("all").alias("slice_key"),
                      (F.col("_any") & F.col(spec.time_col).isNotNull()).alias("is_reported"))


def overlay(detected: DataFrame, spec: AnalysisSpec, ordinals: Sequence[int] | None = None) -> DataFrame:
    """Several lattice series on one time axis in long format
    (``series`` = slice key).  Default: the unsliced series and the full
    subset."""
    if ordinals is None:
        ordinals = [0, spec.n_subsets() - 1]
    return detected.filter(F.col("slice_ordinal").isin(list(ordinals))).select(
        F.col("slice_key").alias("series"), F.col(spec.time_col), F.col("total_metric"),
        F.col("rolling_mean"), F.col("rolling_std"), F.col("is_outlier"),
    )


def eda_points(series: DataFrame) -> DataFrame:
    """O5 for the exploratory chart: the flagged periods of any series with the
    EDA rules, their point class, legend label and colour (count rule included)."""
    return findings(series).selectExpr("*", f"{point_class_sql('anomaly_types')} AS point_class").selectExpr(
        "*", f"{point_label_sql('point_class', EDA_POINT_LABELS)} AS label",
        f"{point_color_sql('point_class', EDA_POINT_COLORS)} AS color")


def value_overlay(series: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """J3 for all per-value series on one time axis, in long format."""
    return series.select(F.concat_ws("_", "variable", "value").alias("series"), "variable", "value", F.col(spec.time_col),
                         "total_metric", "rolling_mean", "rolling_std", "is_outlier")


def flag_filter(series: DataFrame, flag: str) -> DataFrame:
    """rows where one rule flag is true."""
    return series.filter(F.col(flag))


def multi_rule(series: DataFrame, flags: Sequence[str], min_rules: int = 2) -> DataFrame:
    """rows where at least ``min_rules`` of the given flags are true (NULL
    counts as false)."""
    hits = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags), F.lit(0))
    return series.withColumn("n_rules", hits).filter(F.col("n_rules") >= min_rules)
