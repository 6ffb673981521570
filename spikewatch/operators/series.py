"""Period series: role projection, slice filter, period totals.

A *series* DataFrame has one row per (slice, period) with the metric
total ``total_units`` and the row count ``num_data_points``.  Everything after
this step (windows, rules, findings) runs on series rows, whose number is
bounded by slices x periods and does not grow with the fact rows.
"""

from __future__ import annotations

from typing import Mapping, Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.exprs import metric_units_sql, q, slit
from ..spec import AnalysisSpec


class Measure:
    """How a spec's metric is summed, by partial sums that may meet in any order:
    exact units and decimals in one column, doubles as given by their digits
    (``functions.exact``), so that no total depends on the order of the rows.

    ``split`` adds the row-level columns; group by ``keys`` beside one's own and
    add up ``sums``; ``total`` merges ``keys`` into ``total_units``."""

    def __init__(self, df: DataFrame, spec: AnalysisSpec):
        dtype = dict(df.dtypes).get(spec.metric_col, "double")
        self.units = metric_units_sql(q(spec.metric_col), spec.metric_scale, dtype)
        self.digits = spec.metric_scale is None and self.units.endswith("AS DOUBLE)")
        self.keys = [exact.BIN] if self.digits else []
        self.sums = list(exact.SUMS) if self.digits else ["_units"]

    def split(self, df: DataFrame, *columns: str) -> DataFrame:
        """``columns`` (SQL texts) and the row-level columns of the measure."""
        if not self.digits:
            return df.selectExpr(*columns, f"{self.units} AS _units")
        first, *rest = exact.split_stages(self.units)
        out = df.selectExpr(*columns, *first)
        names = [q(c) for c in out.columns if c != "_x"]
        for stage in rest:
            out = out.selectExpr("*", *stage)
        return out.selectExpr(*names, *self.keys, *self.sums)

    def add(self, count: Optional[str] = None) -> list[Column]:
        """Aggregates of ``sums`` and the row count (of rows, or of a column of counts)."""
        n = F.count(F.lit(1)) if count is None else F.sum(count)
        return [F.sum(c).alias(c) for c in self.sums] + [n.alias("num_data_points")]

    def total(self, parts: DataFrame, *by: str) -> DataFrame:
        """One row per ``by`` with ``total_units`` and ``num_data_points``."""
        if not self.digits:
            return parts.withColumnRenamed("_units", "total_units")
        held = F.collect_list(F.struct(exact.BIN, "_d2", "_d1", "_d0")).alias("_held")
        out = parts.groupBy(*by).agg(held, F.sum("_odd").alias("_odd_sum"), F.sum("num_data_points").alias("num_data_points"))
        for stage in exact.join_stages("_held", "_odd_sum", "total_units"):
            new = {e.rsplit(" AS ", 1)[1] for e in stage}
            out = out.selectExpr(*[q(c) for c in out.columns if c not in new], *stage)
        return out.select(*by, "total_units", "num_data_points")


def role_projection(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Keep the time column, the metric (as ``total_metric``) and the test
    columns; column pruning then reaches the scan."""
    return df.select(
        F.col(spec.time_col),
        F.col(spec.metric_col).alias("total_metric"),
        *[F.col(c) for c in spec.test_cols],
    )


def slice_condition(values: Optional[Mapping[str, object]]) -> Optional[Column]:
    """AND of ``col == value`` for every non-None value; rows with a NULL
    code never match.  ``None`` / empty -> no condition."""
    conds = [F.col(k) == F.lit(v) for k, v in (values or {}).items() if v is not None]
    out = None
    for c in conds:
        out = c if out is None else out & c
    return out


def slice_filter(df: DataFrame, values: Optional[Mapping[str, object]]) -> DataFrame:
    cond = slice_condition(values)
    return df if cond is None else df.filter(cond)


def period_totals(df: DataFrame, spec: AnalysisSpec,
                  values: Optional[Mapping[str, object]] = None) -> DataFrame:
    """A1: per period, the metric total and the row count.

    ``count(*)`` counts rows whose metric is NULL; a period whose metrics are
    all NULL has a NULL total.  The filter is pushed to the scan and the sum is
    partially aggregated before the shuffle by period.
    """
    m = Measure(df, spec)
    parts = m.split(slice_filter(df, values), q(spec.time_col)).groupBy(spec.time_col, *m.keys).agg(*m.add())
    return m.total(parts, spec.time_col)


def value_totals(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """A2 for every test column at once: per (variable, value, period) the
    metric total and the row count.

    One ``groupingSets`` over (period, column) for each test column: Spark
    expands each row once per column (codegen'd ``Expand`` on the native
    types) and partially aggregates in the same stage, so only (variable,
    value, period) partials cross the shuffle, however skewed a value is.
    Values are cast to string -- after aggregation, on the small result -- so
    all dimensions share one column.
    """
    tests = list(spec.test_cols)
    if not tests:
        raise ValueError("value_totals needs at least one test column")
    t = spec.time_col
    k = len(tests)
    m = Measure(df, spec)
    agg = (m.split(df, q(t), *[q(c) for c in tests])
           .groupingSets([[t, c, *m.keys] for c in tests], t, *tests, *m.keys)
           .agg(*m.add(), F.expr("grouping_id()").alias("_gid")))
    if m.keys:  # the bins' bit, the last one, is never set
        agg = agg.withColumn("_gid", F.shiftright("_gid", len(m.keys)))
    agg = m.total(agg, t, *tests, "_gid")
    # grouping_id over (t, c_0..c_{k-1}): column i is the grouped one when its
    # bit (k-1-i) is clear; with one set per column exactly one bit is clear.
    gid = {((1 << k) - 1) ^ (1 << (k - 1 - i)): i for i in range(k)}
    variable = "CASE _gid " + " ".join(f"WHEN {g} THEN {slit(tests[i])}" for g, i in gid.items()) + " END"
    value = "CASE _gid " + " ".join(f"WHEN {g} THEN CAST({q(tests[i])} AS STRING)"
                                     for g, i in gid.items()) + " END"
    return agg.selectExpr(f"{variable} AS variable", f"{value} AS value", q(t), "total_units", "num_data_points")


def week_start(name: str) -> Column:
    """Monday 00:00 of the week of column ``name`` as ``timestamp_ntz``.
    Computed on the wall clock (date arithmetic), so the session time zone
    and its DST changes do not move the bucket, unlike ``date_trunc``."""
    c = q(name)
    return F.expr(f"CAST(date_sub(CAST({c} AS DATE), CAST(pmod(dayofweek({c}) + 5, 7) AS INT)) "
                  f"AS TIMESTAMP_NTZ)")


def hour_start(name: str) -> Column:
    """The hour of column ``name`` as ``timestamp_ntz`` (wall clock, time-zone
    free like ``week_start``)."""
    c = q(name)
    return F.expr(f"make_timestamp_ntz(year({c}), month({c}), day({c}), hour({c}), 0, 0)")
