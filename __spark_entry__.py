"""

``entry(spark)`` runs the flagship query (the whole period-anomaly analysis:
screening, subset lattice, most specific finding per period, report order) on
sf0.001.  ``queries()`` registers one callable per operator group of
``oracle_sql()`` gives the DuckDB SQL that must produce the same rows.

Fixture used throughout: the fact table is ``orders`` joined to ``customer``
and ``nation``; the time axis is ``o_orderdate`` (days), the metric
``o_totalprice`` (money, two decimals) and the test variables
``o_orderpriority``, ``c_nationkey`` (described by ``n_name``) and
``c_mktsegment``.  Query groups: profile (R1), period and slice totals (A1,
A2, F1), windows and rules (W1-W6, D1-D8; DETECT, EDA and event profiles),
screening (A4, A6), the lattice and its findings (A7-A10, W7, O0, J1), the
report and chart tables (R2, R3, O1-O6), and the same analysis run weekly,
in blocked windows and checkpointed -- each checked by the same oracle.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles as O  # noqa: E402
from spikewatch import DETECT, EDA, SCREEN, AnalysisSpec, PeriodAnomalyAnalysis, RuleSet  # noqa: E402
from spikewatch.operators import (anomaly_counts, code_descriptions, data_profile,  # noqa: E402
                                  describe_values, detect, hour_start, null_profile, period_totals,
                                  rolling_columns, top_values, type_profile, value_series,
                                  value_totals, week_start)
from spikewatch.operators.attribute import ranked_findings  # noqa: E402
from spikewatch.plans import chart  # noqa: E402
from spikewatch.plans.report import grouping_text  # noqa: E402
from spikewatch.operators.lattice import subset_series  # noqa: E402
from spikewatch.sources import load_config, profile_rows, read_table, register_view  # noqa: E402
from spikewatch.spec import GUARD_AFTER_Z, GUARD_BEFORE_Z  # noqa: E402

try:  # the training-data operators and their pipeline, if they are there
    import corpus_pipeline
    from spikewatch.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "spikewatch.llm", "spikewatch.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

TESTS = ("o_orderpriority", "c_nationkey", "c_mktsegment")
FACT_SPEC = AnalysisSpec("o_orderdate", "o_totalprice", TESTS, {"c_nationkey": "n_name"}, metric_scale=2)
WEEKLY_FACT_SPEC = AnalysisSpec("o_week", "o_totalprice", TESTS, {"c_nationkey": "n_name"}, metric_scale=2)
DAY_SPEC = AnalysisSpec("o_orderdate", "o_totalprice", metric_scale=2)
WEEK_SPEC = AnalysisSpec("o_week", "o_totalprice", metric_scale=2)
SHIP_SPEC = AnalysisSpec("l_shipdate", "l_extendedprice", metric_scale=2)
EVENTS_SPEC = AnalysisSpec("hour", "value", period_noun="Hours", metric_scale=2)
# Lower cuts for the event stream, whose hourly totals are small.
EVENTS_RULES = RuleSet(z_cut=2.0, jump_up=2.0, jump_down=0.5, jump_min_abs=100.0,
                       shift_ratio=1.5, shift_min_abs=50.0, backfill_first=True,
                       zero_mean_guard=GUARD_AFTER_Z)
WIDE = DETECT.with_(half_window=60, shift_span=25)
EDA_SPEC_GUARD = EDA.with_(zero_mean_guard=GUARD_BEFORE_Z)


# --------------------------------------------------------------------------- inputs

# Declared schemas of the driver tables: a declared schema skips the
# schema-inference job (at scale: reading the footer of every file).
SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{d}/{name}.parquet")


def _fact(spark: SparkSession, d: str) -> DataFrame:
    """orders x customer x nation.  No join hints: Spark sizes the sides
    (nation is broadcast by its measured size; orders/customer at scale is a
    sort-merge join with AQE skew handling)."""
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey))


def _analysis(spark, d) -> PeriodAnomalyAnalysis:
    return PeriodAnomalyAnalysis(_fact(spark, d), FACT_SPEC, DETECT, SCREEN)


def _day_series(spark, d):
    return period_totals(_t(spark, d, "orders"), DAY_SPEC)


def _value(c: str) -> F.Column:
    return (F.col(c).cast("double") / F.lit(100.0)).alias("total_metric")


def _types_text(df: DataFrame) -> DataFrame:
    return df.withColumn("anomaly_types", F.array_join("anomaly_types", ","))


# --------------------------------------------------------------------------- queries

def q_null_profile(spark, d):
    return null_profile(_t(spark, d, "orders"))


def q_type_profile(spark, d):
    return type_profile(_t(spark, d, "orders"))


def q_data_profile(spark, d):
    return data_profile(_t(spark, d, "customer"))


def q_period_totals_day(spark, d):
    return _day_series(spark, d).select("o_orderdate", _value("total_units"), "num_data_points")


def q_period_totals_week(spark, d):
    o = _t(spark, d, "orders").withColumn("o_week", week_start("o_orderdate"))
    return period_totals(o, WEEK_SPEC).select("o_week", _value("total_units"), "num_data_points")


def q_slice_totals_one(spark, d):
    s = period_totals(_t(spark, d, "orders"), DAY_SPEC, {"o_orderpriority": "1-URGENT"})
    return s.select("o_orderdate", _value("total_units"), "num_data_points")


def q_slice_totals_two(spark, d):
    s = period_totals(_t(spark, d, "orders"), DAY_SPEC, {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"})
    return s.select("o_orderdate", _value("total_units"), "num_data_points")


def q_slice_totals_wildcard(spark, d):
    s = period_totals(_t(spark, d, "orders"), DAY_SPEC, {"o_orderpriority": None, "o_orderstatus": "O"})
    return s.select("o_orderdate", _value("total_units"), "num_data_points")


def q_value_totals(spark, d):
    v = value_totals(_fact(spark, d), FACT_SPEC)
    return v.select("variable", "value", "o_orderdate", _value("total_units"), "num_data_points")


def q_lagged(spark, d):
    r = rolling_columns(_day_series(spark, d), DAY_SPEC, DETECT)
    return r.select("o_orderdate", "total_metric", "num_data_points", "prev_total_metric", "prev_num_data_points")


def q_rolling_stats(spark, d):
    r = rolling_columns(_day_series(spark, d), DAY_SPEC, DETECT)
    return r.select("o_orderdate", "total_metric", "rolling_mean", "rolling_std")


def q_shift_means(spark, d):
    r = rolling_columns(_day_series(spark, d), DAY_SPEC, DETECT)
    return r.select("o_orderdate", "mean_prev", "mean_next")


def _detect_day(spark, d, rules=DETECT):
    return detect(_day_series(spark, d), DAY_SPEC, rules)


def q_detect_series(spark, d):
    return _detect_day(spark, d)


def q_detect_series_blocked(spark, d):
    """The same series as detect_series, windows run in blocks of 64 days
    with a halo (the form for very long time axes)."""
    return detect(_day_series(spark, d), DAY_SPEC, DETECT, block_rows=64)


def q_detect_text_axis_blocked(spark, d):
    """Blocked windows over periods named by text: ordered over range partitions."""
    days = _t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice")
    return detect(period_totals(days, DAY_SPEC), DAY_SPEC, DETECT, block_rows=64)


def q_wide_window_series(spark, d):
    """A centred window of 121 days, from running sums."""
    return detect(_day_series(spark, d), DAY_SPEC, WIDE)


def q_wide_value_series(spark, d):
    """The same for every value of every test column."""
    return value_series(_fact(spark, d), FACT_SPEC, WIDE)


def q_wide_series_blocked(spark, d):
    return detect(_day_series(spark, d), DAY_SPEC, WIDE, block_rows=100)


def q_materialized_report_rows(spark, d):
    """report_rows with the two pass results checkpointed (lineage cut into
    the session's checkpoint directory)."""
    a = PeriodAnomalyAnalysis(_fact(spark, d), FACT_SPEC, DETECT, SCREEN, materialize=True)
    return _types_text(ranked_findings(a.selected, FACT_SPEC))


def q_blocked_report_rows(spark, d):
    a = PeriodAnomalyAnalysis(_fact(spark, d), FACT_SPEC, DETECT, SCREEN, block_rows=64)
    return _types_text(ranked_findings(a.selected, FACT_SPEC))


def q_detect_day(spark, d):
    return _detect_day(spark, d).filter(F.col("is_outlier"))


def q_z_flags(spark, d):
    return _detect_day(spark, d).select("o_orderdate", "z_score", "rolling_std", "is_outlier_z")


def q_jump_flags(spark, d):
    return _detect_day(spark, d).select("o_orderdate", "total_metric", "prev_total_metric", "is_outlier_metric")


def q_change_points(spark, d):
    return _detect_day(spark, d).select("o_orderdate", "mean_prev", "mean_next", "change_point")


def q_eda_series(spark, d):
    return _detect_day(spark, d, EDA)


def q_eda_guard_series(spark, d):
    return _detect_day(spark, d, EDA_SPEC_GUARD)


def q_count_jumps(spark, d):
    s = detect(period_totals(_t(spark, d, "lineitem"), SHIP_SPEC), SHIP_SPEC, EDA)
    return s.select("l_shipdate", "num_data_points", "prev_num_data_points", "is_outlier_count")


def q_flag_filter(spark, d):
    return chart.flag_filter(_detect_day(spark, d, EDA), "is_outlier_metric")


def q_multi_rule(spark, d):
    s = _detect_day(spark, d, EDA)
    return chart.multi_rule(s, ["is_outlier_z", "is_outlier_count", "is_outlier_metric"])


def q_screen_series(spark, d):
    return value_series(_fact(spark, d), FACT_SPEC, SCREEN)


def q_anomaly_counts(spark, d):
    return anomaly_counts(value_series(_fact(spark, d), FACT_SPEC, SCREEN))


def q_top_values(spark, d):
    return top_values(anomaly_counts(value_series(_fact(spark, d), FACT_SPEC, SCREEN)))


def q_code_descriptions(spark, d):
    return code_descriptions(_fact(spark, d), FACT_SPEC)


def q_described_counts(spark, d):
    fact = _fact(spark, d)
    counts = anomaly_counts(value_series(fact, FACT_SPEC, SCREEN))
    return describe_values(counts, code_descriptions(fact, FACT_SPEC))


def q_subset_totals(spark, d):
    a = _analysis(spark, d)
    return a.lattice.select(*a.lattice.columns[:-3], _value("total_units"), "num_data_points", "slice_key") \
        .drop("total_units")


def q_subset_series(spark, d):
    return _analysis(spark, d).detected


def q_subset_findings(spark, d):
    return _types_text(_analysis(spark, d).found)


def q_most_specific(spark, d):
    return _types_text(_analysis(spark, d).selected)


def q_report_rows(spark, d):
    a = _analysis(spark, d)
    return _types_text(ranked_findings(a.selected, FACT_SPEC))


def q_described_findings(spark, d):
    a = _analysis(spark, d)
    return _types_text(a.selected.select(
        "o_orderdate", "slice_key", grouping_text(FACT_SPEC).alias("grouping"),
        "total_metric", "anomaly_types"))


def q_report_text(spark, d):
    return _analysis(spark, d).report


def _weekly_analysis(spark, d) -> PeriodAnomalyAnalysis:
    fact = _fact(spark, d).withColumn("o_week", week_start("o_orderdate"))
    return PeriodAnomalyAnalysis(fact, WEEKLY_FACT_SPEC, DETECT, SCREEN)


def q_weekly_report_rows(spark, d):
    a = _weekly_analysis(spark, d)
    return _types_text(ranked_findings(a.selected, WEEKLY_FACT_SPEC))


def q_weekly_report_text(spark, d):
    return _weekly_analysis(spark, d).report


def q_any_flag(spark, d):
    return _detect_day(spark, d).select("o_orderdate", "is_outlier_z", "is_outlier_metric", "change_point",
                                        "is_outlier")


def q_bands(spark, d):
    return _analysis(spark, d).bands()


def q_chart_points(spark, d):
    return _types_text(_analysis(spark, d).points())


def q_reported_axis(spark, d):
    return _analysis(spark, d).axis().select("o_orderdate", "total_metric", "is_reported")


def q_overlay(spark, d):
    return _analysis(spark, d).overlay()


def q_events_hourly(spark, d):
    e = _t(spark, d, "events").withColumn("hour", hour_start("ts"))
    return detect(period_totals(e, EVENTS_SPEC), EVENTS_SPEC, EVENTS_RULES)


def q_shipments_weekly(spark, d):
    li = _t(spark, d, "lineitem").withColumn("l_week", week_start("l_shipdate"))
    spec = AnalysisSpec("l_week", "l_extendedprice", metric_scale=2)
    rules = DETECT.with_(jump_min_abs=50000.0, shift_min_abs=50000.0, z_cut=2.0)
    return detect(period_totals(li, spec), spec, rules)


# -- the metric as it is given (no scale): doubles, decimals, integers

def q_raw_metric_totals(spark, d):
    """A metric below one cent, summed as doubles."""
    li = _t(spark, d, "lineitem").withColumn("saving", F.col("l_extendedprice") * F.col("l_discount") / 1000)
    s = period_totals(li, AnalysisSpec("l_shipdate", "saving"))
    return s.select("l_shipdate", F.col("total_units").alias("total_metric"), "num_data_points")


RAW_SPEC = AnalysisSpec("o_orderdate", "margin", TESTS)


def _margins(spark, d):
    """A metric in doubles of very different sizes and either sign."""
    return _fact(spark, d).withColumn("margin", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END / "
                                                       "CASE o_orderkey % 4 WHEN 0 THEN 7e0 WHEN 1 THEN 65536e0 WHEN 2 THEN 0.0009765625e0 ELSE 3e0 END"))


def q_raw_value_totals(spark, d):
    """Doubles summed as given, for every value: the exact sum, rounded once."""
    return value_totals(_margins(spark, d), RAW_SPEC).withColumnRenamed("total_units", "total_metric")


def q_raw_subset_totals(spark, d):
    s = subset_series(_margins(spark, d), RAW_SPEC, {"o_orderpriority": "1-URGENT", "c_nationkey": "7", "c_mktsegment": "BUILDING"})
    return s.select("o_orderdate", "slice_ordinal", F.col("total_units").alias("total_metric"), "num_data_points")


def q_decimal_totals(spark, d):
    o = _t(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    s = period_totals(o, AnalysisSpec("o_orderdate", "price"))
    return s.select("o_orderdate", F.col("total_units").cast("string").alias("total_metric"), "num_data_points")


def q_bigint_totals(spark, d):
    """Integers that no double holds."""
    o = _t(spark, d, "orders").withColumn("big", F.col("o_orderkey") + F.lit(9007199254740993))
    s = period_totals(o, AnalysisSpec("o_orderdate", "big"))
    return s.select("o_orderdate", F.col("total_units").cast("string").alias("total_metric"), "num_data_points")


# -- the lattice over eleven test columns, and codes with several descriptions

MANY = {"c0": "l_returnflag", "c1": "l_linestatus", "c2": "l_linenumber", "c3": "CAST(l_quantity AS INT) % 5",
        "c4": "l_suppkey % 3", "c5": "l_partkey % 4", "c6": "l_orderkey % 3", "c7": "l_partkey % 3", "c8": "l_suppkey % 2",
        "c9": "l_orderkey % 2", "c10": "CAST(l_quantity AS INT) % 3"}
MANY_TOP = {"c0": "R", "c1": "F", "c2": "1", **{f"c{i}": "1" for i in range(3, 11)}}
MANY_SPEC = AnalysisSpec("l_month", "l_quantity", tuple(MANY), metric_scale=0)
SEGMENT_SPEC = AnalysisSpec("o_orderdate", "o_totalprice", ("o_orderpriority", "c_nationkey"), {"c_nationkey": "c_mktsegment"},
                            metric_scale=2)
SEGMENT_TOP = {"o_orderpriority": "1-URGENT", "c_nationkey": "7"}


def q_many_test_columns(spark, d):
    li = _t(spark, d, "lineitem").selectExpr("year(l_shipdate) * 100 + month(l_shipdate) AS l_month", "l_quantity",
                                             *[f"{e} AS {c}" for c, e in MANY.items()])
    s = subset_series(li, MANY_SPEC, MANY_TOP)
    return s.select("l_month", "n_keys", "slice_ordinal", F.col("total_units").alias("total_metric"), "num_data_points")


WIDE_TESTS = {f"c{i}": f"l_partkey * {2 * i + 3} + l_orderkey * {i % 7 + 1} + l_linenumber * {i + 1}" for i in range(70)}
WIDE_SPEC = AnalysisSpec("l_year", "l_quantity", tuple(WIDE_TESTS), metric_scale=0)


def _wide_value(i: int) -> str:
    """Test column ``i`` of 70: one of 61 + i values, so that a row holds few top values."""
    return f"CAST(({WIDE_TESTS[f'c{i}']}) % {61 + i} AS INT)"


def q_seventy_test_columns(spark, d):
    """Masks of two integers and ordinals beyond a long."""
    li = _t(spark, d, "lineitem").selectExpr("year(l_shipdate) AS l_year", "l_quantity", *[f"{_wide_value(i)} AS c{i}" for i in range(70)])
    s = subset_series(li, WIDE_SPEC, {c: "1" for c in WIDE_TESTS})
    return s.select("l_year", "n_keys", F.col("slice_ordinal").cast("string").alias("slice_ordinal"),
                    F.col("total_units").alias("total_metric"), "num_data_points")


def q_one_description_per_code(spark, d):
    s = subset_series(_fact(spark, d), SEGMENT_SPEC, SEGMENT_TOP)
    return s.select("o_orderdate", "slice_ordinal", "c_mktsegment", _value("total_units"), "num_data_points")


# -- exploratory charts over many series

def _eda_values(spark, d):
    return value_series(_fact(spark, d), FACT_SPEC, EDA)


def q_eda_bands(spark, d):
    """The band of two deviations around every per-value series."""
    return chart.bands(_eda_values(spark, d), EDA, 2.0).select(
        "variable", "value", "o_orderdate", "total_metric", "rolling_mean", "rolling_std", "lower_bound", "upper_bound")


def q_eda_points(spark, d):
    s = detect(period_totals(_t(spark, d, "lineitem"), SHIP_SPEC), SHIP_SPEC, EDA)
    return chart.eda_points(s).select("l_shipdate", "total_metric", "num_data_points", "point_class", "label", "color")


def q_value_overlay(spark, d):
    return chart.value_overlay(_eda_values(spark, d), FACT_SPEC)


# -- runs of zeros, NULL totals, windows with mean 0 and a deviation

HARD_SPEC = AnalysisSpec("o_orderdate", "m", metric_scale=2)


def _hard_days(spark, d):
    """Every order date once, with a metric that reaches the guards: zeros in a
    row, NULLs, and a week's pattern that adds up to nothing."""
    days = _t(spark, d, "orders").select("o_orderdate").distinct()
    n = "datediff(o_orderdate, DATE'1992-01-01')"
    return days.selectExpr("o_orderdate", f"CAST(CASE WHEN {n} % 211 < 20 THEN 0 WHEN {n} % 97 = 5 THEN NULL WHEN {n} DIV 300 % 2 = 0 "
                           f"THEN element_at(array(3, -3, 2, -2, 1, -1, 0), {n} % 7 + 1) * 1000 ELSE {n} * 7919 % 20000 END AS DOUBLE) AS m")


def q_hard_series(spark, d):
    return detect(period_totals(_hard_days(spark, d), HARD_SPEC), HARD_SPEC, DETECT)


def q_hard_guard_before(spark, d):
    return detect(period_totals(_hard_days(spark, d), HARD_SPEC), HARD_SPEC, EDA_SPEC_GUARD)


def q_hard_guard_none(spark, d):
    return detect(period_totals(_hard_days(spark, d), HARD_SPEC), HARD_SPEC, EDA)


def q_view_totals(spark, d):
    """The source reader with options, registered as a view and read back by name."""
    register_view(read_table(spark, f"{d}/orders.parquet", "parquet", {"mergeSchema": "false"}), "spikewatch_orders")
    return period_totals(spark.table("spikewatch_orders"), DAY_SPEC).select("o_orderdate", _value("total_units"), "num_data_points")


CONFIG = {
    "dataset": {"name": "orders", "format": "parquet"},
    "variables": {"o_orderkey": {"type": "bigint"}, "o_orderdate": {"type": "timestamp", "time_variable": True},
                  "o_orderpriority": {"type": "string", "test_variable": True}, "o_totalprice": {"type": "double", "metric_variable": True},
                  "o_orderstatus": {"type": "string", "test_variable": True}},
}


def _configured(spark, d):
    """S3: table and column roles from a job configuration."""
    source, spec = load_config(CONFIG, metric_scale=2)
    return read_table(spark, f"{d}/{source.name}.parquet", source.format, source.options), spec


def q_configured_value_totals(spark, d):
    table, spec = _configured(spark, d)
    v = value_totals(table, spec)
    return v.select("variable", "value", "o_orderdate", _value("total_units"), "num_data_points")


def q_configured_top_values(spark, d):
    table, spec = _configured(spark, d)
    return top_values(anomaly_counts(value_series(table, spec, SCREEN)))


def q_configured_profile(spark, d):
    """The profile that the job writes, of the configured table."""
    table, _ = _configured(spark, d)
    return profile_rows(data_profile(table))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the whole analysis on sf0.001 -> the most specific finding
    per flagged period, numbered in report order."""
    return q_report_rows(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm_queries is None:
        return dict(_QUERIES)
    return {**_QUERIES, **llm_queries.queries(), "pipeline": corpus_pipeline.run}


# --------------------------------------------------------------------------- oracles

FACT = ("(SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey)")


def _day_series_sql(where: str = "") -> str:
    return O.series_sql("orders", "o_orderdate", "o_totalprice", where=where)


def _totals_sql(series: str, t: str) -> str:
    return f"SELECT {t}, {O.to_value('tu')} AS total_metric, n AS num_data_points FROM ({series}) _s"


def _detect_day_sql(rules=DETECT) -> str:
    return O.detect_sql(_day_series_sql(), "o_orderdate", rules)


# The analysis oracles take the fact source, the time column and the period
# noun, so the same statements serve the daily and the weekly runs.
T = "o_orderdate"


def _value_totals_sql(fact=FACT, t=T) -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, {t}, "
             f"{O.units('o_totalprice')} AS u FROM {fact} _f" for c in TESTS]
    stacked = " UNION ALL ".join(parts)
    return (f"SELECT variable, value, {t}, CAST(SUM(u) AS BIGINT) AS tu, COUNT(*) AS n "
            f"FROM ({stacked}) _u GROUP BY variable, value, {t}")


def _screen_sql(fact=FACT, t=T) -> str:
    return O.detect_sql(_value_totals_sql(fact, t), t, SCREEN, keys=("variable", "value"))


def _counts_sql(fact=FACT, t=T) -> str:
    return (f"SELECT variable, value, CAST(COALESCE(SUM(CAST(is_outlier AS INTEGER)), 0) AS BIGINT) "
            f"AS anomaly_count FROM ({_screen_sql(fact, t)}) _x GROUP BY variable, value")


def _top_sql(fact=FACT, t=T) -> str:
    return (f"SELECT variable, value, anomaly_count FROM (SELECT *, ROW_NUMBER() OVER "
            f"(PARTITION BY variable ORDER BY anomaly_count DESC, value ASC) AS _r FROM ({_counts_sql(fact, t)}) _c "
            f"WHERE value IS NOT NULL) _t WHERE _r = 1")


_NATIVE = {"o_orderpriority": "VARCHAR", "c_nationkey": "INTEGER", "c_mktsegment": "VARCHAR"}


def _lattice_series_sql(fact=FACT, t=T) -> str:
    """One filter-then-aggregate per subset, UNION ALL (the reference's
    formulation); columns as ``subset_series`` plus tu / n."""
    top = f"({_top_sql(fact, t)})"
    selects = []
    for j, s in enumerate(FACT_SPEC.subsets()):
        conds = [f"CAST({TESTS[i]} AS VARCHAR) = (SELECT value FROM {top} _q WHERE variable = '{TESTS[i]}')"
                 for i in s]
        where = (" WHERE " + " AND ".join(conds)) if conds else ""
        cols = [t]
        for i, c in enumerate(TESTS):
            cols.append(f"MIN({c}) AS {c}" if i in s else f"CAST(NULL AS {_NATIVE[c]}) AS {c}")
        cols += [f"CAST(SUM({O.units('o_totalprice')}) AS BIGINT) AS tu", "COUNT(*) AS n"]
        grouped = f"SELECT {', '.join(cols)} FROM {fact} _f{where} GROUP BY {t}"
        desc = (f"(SELECT MIN(n_name) FROM {fact} _d{where})" if 1 in s else "CAST(NULL AS VARCHAR)")
        label = ", ".join(f"'\"{c}\":\"' || CAST({c} AS VARCHAR) || '\"'" for c in TESTS)
        selects.append(
            f"SELECT {t}, {', '.join(TESTS)}, {desc} AS n_name, CAST({len(s)} AS INTEGER) AS n_keys, "
            f"CAST({j} AS INTEGER) AS slice_ordinal, tu, n, "
            f"CASE WHEN concat_ws(',', {label}) = '' THEN 'all' ELSE '{{' || concat_ws(',', {label}) || '}}' END AS slice_key "
            f"FROM ({grouped}) _g")
    return " UNION ALL ".join(selects)


_SLICE_CARRY = (*TESTS, "n_name", "n_keys", "slice_key")


def _subset_detect_sql(fact=FACT, t=T) -> str:
    return O.detect_sql(_lattice_series_sql(fact, t), t, DETECT, keys=("slice_ordinal",), carry=_SLICE_CARRY)


def _findings_sql(fact=FACT, t=T) -> str:
    return (f"SELECT *, {O.rule_names_sql()} AS anomaly_types FROM ({_subset_detect_sql(fact, t)}) _d "
            f"WHERE is_outlier")


def _most_specific_sql(fact=FACT, t=T) -> str:
    return (f"SELECT * EXCLUDE (_pick) FROM (SELECT *, MIN(slice_ordinal) OVER (PARTITION BY {t}) "
            f"AS first_ordinal, ROW_NUMBER() OVER (PARTITION BY {t} ORDER BY n_keys DESC, "
            f"total_metric DESC NULLS LAST, slice_ordinal ASC) AS _pick FROM ({_findings_sql(fact, t)}) _f) _m "
            f"WHERE _pick = 1")


def _report_rows_sql(fact=FACT, t=T) -> str:
    return (f"SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY total_metric DESC NULLS LAST, first_ordinal ASC, "
            f"{t} ASC) AS INTEGER) AS report_rank, COUNT(*) OVER () AS n_blocks "
            f"FROM ({_most_specific_sql(fact, t)}) _s")


def _grouping_sql() -> str:
    parts = ["CASE WHEN o_orderpriority IS NULL THEN 'All' ELSE o_orderpriority END",
             "CASE WHEN c_nationkey IS NULL THEN 'All' ELSE COALESCE(n_name, 'None') END",
             "CASE WHEN c_mktsegment IS NULL THEN 'All' ELSE c_mktsegment END"]
    return f"('Grouping: ' || concat_ws(', ', {', '.join(parts)}))"


def _report_text_sql(fact=FACT, t=T, noun="Days") -> str:
    from spikewatch.plans.report import BLOCK_RULE, header_lines

    def lit_list(items):
        return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"

    empty = "CAST([] AS VARCHAR[])"
    x = O.money("total_metric")
    metric = (f"['Metric Anomaly:', '  - Total Cost: ' || {x}, "
              f"'  - Previous Week Cost: ' || {O.money('prev_total_metric')}]")
    change = (f"['Change Point:', '  - Total Cost: ' || {x}, "
              f"'  - Previous Two {noun} Average Cost: ' || {O.money('mean_prev')}, "
              f"'  - Next Two {noun} Average Cost: ' || {O.money('mean_next')}]")
    zsec = (f"['Z-Score Anomaly:', '  - Total Cost: ' || {x}, '  - Rolling Mean: ' || {O.money('rolling_mean')}, "
            f"'  - Standard Deviation: ' || {O.money('rolling_std')}, "
            f"'  - Z-Score: ' || printf('%.2f', (total_metric - rolling_mean) / rolling_std)]")
    g = _grouping_sql()
    head = (f"['Week: ' || CAST({t} AS VARCHAR), '{BLOCK_RULE}', {g}, repeat('-', length({g}))]")
    lines = f"list_concat(CASE WHEN report_rank = 1 THEN [''] ELSE {empty} END, {head})"
    for cond, sec in (("is_outlier_metric", metric), ("change_point", change), ("is_outlier_z", zsec)):
        lines = f"list_concat({lines}, CASE WHEN {cond} THEN {sec} ELSE {empty} END)"
    lines = f"list_concat({lines}, CASE WHEN report_rank = n_blocks THEN ['', '', ''] ELSE ['', '', '', ''] END)"
    rows = _report_rows_sql(fact, t)
    header = f"SELECT CAST(0 AS INTEGER) AS report_rank, {lit_list(header_lines(2.1) + [''])} AS lines"
    blocks = f"SELECT report_rank, {lines} AS lines FROM ({rows}) _r"
    return (f"SELECT report_rank, CAST(UNNEST(range(len(lines))) AS INTEGER) AS line_no, UNNEST(lines) AS value "
            f"FROM ({header} UNION ALL {blocks}) _l")


def _base_sql() -> str:
    return f"SELECT * EXCLUDE ({', '.join(TESTS)}, n_name, n_keys, slice_ordinal) FROM ({_subset_detect_sql()}) _d " \
           f"WHERE slice_ordinal = 0"


WEEK_FACT = (f"(SELECT *, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS o_week FROM {FACT} _w)")


def _orders_profile_rows(table: str, cols: list[tuple[str, str]]) -> str:
    parts = [f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, '{t}' AS data_type, "
             f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM {table}" for i, (c, t) in enumerate(cols)]
    return " UNION ALL ".join(parts)


_ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
_CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _many_sql() -> str:
    """Every row against every subset it is in; ordinals by sorting the subsets."""
    k = len(MANY)
    bits = " + ".join(f"CASE WHEN CAST({e} AS VARCHAR) = '{MANY_TOP[c]}' THEN {1 << i} ELSE 0 END" for i, (c, e) in enumerate(MANY.items()))
    turned = " + ".join(f"((s.mask >> {i}) & 1) * {1 << (k - 1 - i)}" for i in range(k))
    return (f"WITH r AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS l_month, {bits} AS mask, "
            f"SUM(CAST(l_quantity AS DECIMAL(18,0))) AS q, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), "
            f"s AS (SELECT mask, bit_count(mask) AS n_keys, row_number() OVER (ORDER BY bit_count(mask), {turned} DESC) - 1 AS ordinal "
            f"FROM (SELECT CAST(range AS INTEGER) AS mask FROM range({1 << k})) s) "
            f"SELECT l_month, CAST(n_keys AS INTEGER) AS n_keys, CAST(ordinal AS INTEGER) AS slice_ordinal, CAST(SUM(q) AS BIGINT) AS total_metric, "
            f"CAST(SUM(n) AS BIGINT) AS num_data_points FROM r JOIN s ON (r.mask & s.mask) = s.mask GROUP BY l_month, n_keys, ordinal")


def _wide_sql() -> str:
    """Every set of top values that some row holds, cleared bit by bit; ordinals from binomials."""
    k = len(WIDE_TESTS)
    one = "CAST(1 AS HUGEINT)"
    bits = " + ".join(f"CASE WHEN {_wide_value(i)} = 1 THEN {one} << {i} ELSE 0 END" for i in range(k))
    binomials = ", ".join(f"({n}, {r}, CAST('{comb(n, r)}' AS HUGEINT))" for n in range(k + 1) for r in range(n + 1) if r <= 12)
    return (f"WITH RECURSIVE r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_year, {bits} AS mask, SUM(CAST(l_quantity AS DECIMAL(18,0))) AS q, "
            f"COUNT(*) AS n FROM lineitem GROUP BY 1, 2), "
            f"i AS (SELECT CAST(range AS INTEGER) AS i FROM range({k})), c AS (SELECT * FROM (VALUES {binomials}) b(n, r, c)), "
            f"p AS (SELECT DISTINCT mask AS big, mask AS sub FROM r UNION SELECT big, sub - ({one} << i) FROM p, i WHERE (sub >> i) & 1 = 1), "
            f"held AS (SELECT sub, i, row_number() OVER (PARTITION BY sub ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY sub) AS size "
            f"FROM (SELECT DISTINCT sub FROM p) s, i WHERE (sub >> i) & 1 = 1), "
            f"rest AS (SELECT sub, MIN(size) AS size, SUM(COALESCE(c.c, 0)) AS after FROM held LEFT JOIN c "
            f"ON c.n = {k} - 1 - i AND c.r = size - j GROUP BY sub), "
            f"o AS (SELECT sub, size, (SELECT COALESCE(SUM(c), 0) FROM c WHERE n = {k} AND r < size) + (SELECT c FROM c WHERE n = {k} AND r = size) - 1 - after "
            f"AS ordinal FROM rest UNION ALL SELECT CAST(0 AS HUGEINT), 0, 0) "
            f"SELECT l_year, CAST(size AS INTEGER) AS n_keys, CAST(CAST(ordinal AS HUGEINT) AS VARCHAR) AS slice_ordinal, "
            f"CAST(SUM(q) AS BIGINT) AS total_metric, CAST(SUM(r.n) AS BIGINT) AS num_data_points "
            f"FROM r JOIN p ON r.mask = p.big JOIN o ON p.sub = o.sub GROUP BY l_year, size, ordinal")


def _raw_sum(x: str, bits: int = 60) -> str:
    """The exact sum of doubles whose bits lie above 2 ^ -``bits``, rounded once."""
    total = f"SUM(CAST(({x}) * CAST({2 ** bits} AS DOUBLE) AS HUGEINT))"
    return f"({O.signed_double(total)} / CAST({2 ** bits} AS DOUBLE))"


_MARGIN = ("CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END / "
           "CASE o_orderkey % 4 WHEN 0 THEN 7e0 WHEN 1 THEN 65536e0 WHEN 2 THEN 0.0009765625e0 ELSE 3e0 END")


def _raw_value_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, o_orderdate, {_raw_sum(_MARGIN)} AS total_metric, "
        f"COUNT(*) AS num_data_points FROM {FACT} _f GROUP BY {c}, o_orderdate" for c in TESTS)


def _raw_subset_sql() -> str:
    held = ["o_orderpriority = '1-URGENT'", "c_nationkey = 7", "c_mktsegment = 'BUILDING'"]
    return " UNION ALL ".join(
        f"SELECT o_orderdate, CAST({j} AS INTEGER) AS slice_ordinal, {_raw_sum(_MARGIN)} AS total_metric, COUNT(*) AS num_data_points "
        f"FROM {FACT} _f WHERE {' AND '.join(['true', *[held[i] for i in s]])} GROUP BY o_orderdate"
        for j, s in enumerate(FACT_SPEC.subsets()))


def _configured_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {c} AS value, o_orderdate, CAST(SUM({O.units('o_totalprice')}) AS BIGINT) AS tu, COUNT(*) AS n "
        f"FROM orders GROUP BY {c}, o_orderdate" for c in ("o_orderpriority", "o_orderstatus"))


def _configured_top_sql() -> str:
    screened = O.detect_sql(_configured_sql(), "o_orderdate", SCREEN, keys=("variable", "value"))
    counts = f"SELECT variable, value, CAST(COALESCE(SUM(CAST(is_outlier AS INTEGER)), 0) AS BIGINT) AS anomaly_count FROM ({screened}) _x GROUP BY 1, 2"
    return (f"SELECT variable, value, anomaly_count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY anomaly_count DESC, value) AS _r "
            f"FROM ({counts}) _c WHERE value IS NOT NULL) _t WHERE _r = 1")


def _one_description_sql() -> str:
    parts = []
    for j, (urgent, nation) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        where = ("o_orderpriority = '1-URGENT'" if urgent else "true") + (" AND c_nationkey = 7" if nation else "")
        text = f"(SELECT MIN(c_mktsegment) FROM {FACT} _a WHERE c_nationkey = 7)" if nation else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT o_orderdate, CAST({j} AS INTEGER) AS slice_ordinal, {text} AS c_mktsegment, "
                     f"{O.to_value('CAST(SUM(' + O.units('o_totalprice') + ') AS BIGINT)')} AS total_metric, COUNT(*) AS num_data_points "
                     f"FROM {FACT} _f WHERE {where} GROUP BY o_orderdate")
    return " UNION ALL ".join(parts)


def _hard_sql(rules) -> str:
    n = "date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))"
    src = (f"(SELECT o_orderdate, CAST(CASE WHEN {n} % 211 < 20 THEN 0 WHEN {n} % 97 = 5 THEN NULL WHEN {n} // 300 % 2 = 0 "
           f"THEN [3, -3, 2, -2, 1, -1, 0][{n} % 7 + 1] * 1000 ELSE {n} * 7919 % 20000 END AS DOUBLE) AS m "
           f"FROM (SELECT DISTINCT o_orderdate FROM orders) _d)")
    return O.detect_sql(O.series_sql(src, "o_orderdate", "m"), "o_orderdate", rules)


def oracle_sql() -> dict[str, str]:
    prof = _orders_profile_rows("orders", _ORDERS_COLS)
    day = _day_series_sql()
    rolled = O.rolled_sql(day, "o_orderdate", DETECT)
    week_series = O.series_sql("(SELECT *, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS o_week "
                               "FROM orders)", "o_week", "o_totalprice")
    ship = O.series_sql("lineitem", "l_shipdate", "l_extendedprice")
    eda = _detect_day_sql(EDA)
    events = O.series_sql("(SELECT *, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events)",
                          "hour", "value")
    li_week = O.series_sql("(SELECT *, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS l_week "
                           "FROM lineitem)", "l_week", "l_extendedprice")
    eda_values = O.detect_sql(_value_totals_sql(), T, EDA, keys=("variable", "value"))
    ms = _most_specific_sql()
    base = _base_sql()
    shipments_rules = DETECT.with_(jump_min_abs=50000.0, shift_min_abs=50000.0, z_cut=2.0)
    own = {
        "null_profile": f"SELECT ordinal, column_name, null_count FROM ({prof}) _p",
        "type_profile": f"SELECT ordinal, column_name, data_type FROM ({prof}) _p",
        "data_profile": _orders_profile_rows("customer", _CUSTOMER_COLS),
        "period_totals_day": _totals_sql(day, "o_orderdate"),
        "period_totals_week": _totals_sql(week_series, "o_week"),
        "slice_totals_one": _totals_sql(_day_series_sql("o_orderpriority = '1-URGENT'"), "o_orderdate"),
        "slice_totals_two": _totals_sql(_day_series_sql("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
                                        "o_orderdate"),
        "slice_totals_wildcard": _totals_sql(_day_series_sql("o_orderstatus = 'O'"), "o_orderdate"),
        "value_totals": (f"SELECT variable, value, o_orderdate, {O.to_value('tu')} AS total_metric, "
                         f"n AS num_data_points FROM ({_value_totals_sql()}) _v"),
        "lagged": (f"SELECT o_orderdate, total_metric, num_data_points, prev_total_metric, prev_num_data_points "
                   f"FROM ({rolled}) _r"),
        "rolling_stats": f"SELECT o_orderdate, total_metric, rolling_mean, rolling_std FROM ({rolled}) _r",
        "shift_means": f"SELECT o_orderdate, mean_prev, mean_next FROM ({rolled}) _r",
        "detect_series": _detect_day_sql(),
        "detect_series_blocked": _detect_day_sql(),
        "detect_text_axis_blocked": O.detect_sql(O.series_sql("(SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders)",
                                                              "o_orderdate", "o_totalprice"), "o_orderdate", DETECT),
        "wide_window_series": _detect_day_sql(WIDE),
        "wide_series_blocked": _detect_day_sql(WIDE),
        "wide_value_series": O.detect_sql(_value_totals_sql(), T, WIDE, keys=("variable", "value")),
        "raw_value_totals": _raw_value_sql(),
        "raw_subset_totals": _raw_subset_sql(),
        "seventy_test_columns": _wide_sql(),
        "configured_value_totals": (f"SELECT variable, value, o_orderdate, {O.to_value('tu')} AS total_metric, n AS num_data_points "
                                    f"FROM ({_configured_sql()}) _v"),
        "configured_top_values": _configured_top_sql(),
        "configured_profile": " UNION ALL ".join(
            f"SELECT '{c}' AS \"Column\", COUNT(*) - COUNT({c}) AS \"Null Count\", '{kind}' AS \"Data Type\" FROM orders" for c, kind in _ORDERS_COLS),
        "blocked_report_rows": _report_rows_sql(),
        "materialized_report_rows": _report_rows_sql(),
        "detect_day": f"SELECT * FROM ({_detect_day_sql()}) _d WHERE is_outlier",
        "z_flags": f"SELECT o_orderdate, z_score, rolling_std, is_outlier_z FROM ({_detect_day_sql()}) _d",
        "jump_flags": (f"SELECT o_orderdate, total_metric, prev_total_metric, is_outlier_metric "
                       f"FROM ({_detect_day_sql()}) _d"),
        "change_points": f"SELECT o_orderdate, mean_prev, mean_next, change_point FROM ({_detect_day_sql()}) _d",
        "eda_series": eda,
        "eda_guard_series": _detect_day_sql(EDA_SPEC_GUARD),
        "count_jumps": (f"SELECT l_shipdate, num_data_points, prev_num_data_points, is_outlier_count "
                        f"FROM ({O.detect_sql(ship, 'l_shipdate', EDA)}) _d"),
        "flag_filter": f"SELECT * FROM ({eda}) _d WHERE is_outlier_metric",
        "multi_rule": (f"SELECT * FROM (SELECT *, CAST(COALESCE(is_outlier_z, false) AS INTEGER) + "
                       f"CAST(COALESCE(is_outlier_count, false) AS INTEGER) + "
                       f"CAST(COALESCE(is_outlier_metric, false) AS INTEGER) AS n_rules FROM ({eda}) _d) _m "
                       f"WHERE n_rules >= 2"),
        "screen_series": _screen_sql(),
        "anomaly_counts": _counts_sql(),
        "top_values": _top_sql(),
        "code_descriptions": (f"SELECT DISTINCT 'c_nationkey' AS variable, CAST(c_nationkey AS VARCHAR) AS value, "
                              f"CAST(n_name AS VARCHAR) AS description FROM {FACT} _f"),
        "described_counts": (
            f"SELECT c.variable, c.value, c.anomaly_count, CASE WHEN c.value IS NULL THEN 'All' "
            f"ELSE COALESCE(d.description, 'Unknown') END AS description FROM ({_counts_sql()}) c LEFT JOIN "
            f"(SELECT 'c_nationkey' AS variable, CAST(c_nationkey AS VARCHAR) AS value, MIN(n_name) AS description "
            f"FROM {FACT} _f GROUP BY c_nationkey) d ON c.variable = d.variable AND c.value = d.value"),
        "subset_totals": (f"SELECT o_orderdate, {', '.join(TESTS)}, n_name, n_keys, slice_ordinal, "
                          f"{O.to_value('tu')} AS total_metric, n AS num_data_points, slice_key "
                          f"FROM ({_lattice_series_sql()}) _l"),
        "subset_series": _subset_detect_sql(),
        "subset_findings": _findings_sql(),
        "most_specific": ms,
        "report_rows": _report_rows_sql(),
        "described_findings": (f"SELECT o_orderdate, slice_key, {_grouping_sql()} AS grouping, total_metric, "
                               f"anomaly_types FROM ({ms}) _m"),
        "report_text": _report_text_sql(),
        "bands": (f"SELECT *, rolling_mean - 2.1 * rolling_std AS lower_bound, "
                  f"rolling_mean + 2.1 * rolling_std AS upper_bound FROM ({base}) _b"),
        "chart_points": (
            f"SELECT b.o_orderdate, b.total_metric, m.slice_key, m.anomaly_types, "
            f"CASE WHEN length(m.anomaly_types) - length(replace(m.anomaly_types, ',', '')) > 0 "
            f"THEN 'multiple' ELSE m.anomaly_types END AS point_class, "
            f"CASE WHEN strpos(m.anomaly_types, ',') > 0 THEN 'Multiple Outliers' "
            f"WHEN m.anomaly_types = 'z_score' THEN 'Z score Outliers' "
            f"WHEN m.anomaly_types = 'metric' THEN 'Metric Outliers' ELSE 'Change Point' END AS label, "
            f"CASE WHEN strpos(m.anomaly_types, ',') > 0 THEN 'purple' WHEN m.anomaly_types = 'z_score' THEN 'red' "
            f"WHEN m.anomaly_types = 'metric' THEN 'green' ELSE 'blue' END AS color "
            f"FROM ({base}) b JOIN ({ms}) m ON b.o_orderdate = m.o_orderdate"),
        "reported_axis": (f"SELECT b.o_orderdate, b.total_metric, (m.o_orderdate IS NOT NULL) AS is_reported "
                          f"FROM ({base}) b LEFT JOIN ({ms}) m ON b.o_orderdate = m.o_orderdate"),
        "overlay": (f"SELECT slice_key AS series, o_orderdate, total_metric, rolling_mean, rolling_std, is_outlier "
                    f"FROM ({_subset_detect_sql()}) _d WHERE slice_ordinal IN (0, 7)"),
        "events_hourly": O.detect_sql(events, "hour", EVENTS_RULES),
        "any_flag": (f"SELECT o_orderdate, is_outlier_z, is_outlier_metric, change_point, is_outlier "
                     f"FROM ({_detect_day_sql()}) _d"),
        "weekly_report_rows": _report_rows_sql(WEEK_FACT, "o_week"),
        "weekly_report_text": _report_text_sql(WEEK_FACT, "o_week", "Weeks"),
        "shipments_weekly": O.detect_sql(li_week, "l_week", shipments_rules),
        "raw_metric_totals": f"SELECT l_shipdate, {_raw_sum('(l_extendedprice * l_discount / 1000)')} AS total_metric, "
                             "COUNT(*) AS num_data_points FROM lineitem GROUP BY l_shipdate",
        "decimal_totals": "SELECT o_orderdate, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total_metric, "
                          "COUNT(*) AS num_data_points FROM orders GROUP BY o_orderdate",
        "bigint_totals": "SELECT o_orderdate, CAST(SUM(o_orderkey + 9007199254740993) AS VARCHAR) AS total_metric, "
                         "COUNT(*) AS num_data_points FROM orders GROUP BY o_orderdate",
        "many_test_columns": _many_sql(),
        "one_description_per_code": _one_description_sql(),
        "eda_bands": (f"SELECT variable, value, o_orderdate, total_metric, rolling_mean, rolling_std, rolling_mean - 2.0 * rolling_std AS lower_bound, "
                      f"rolling_mean + 2.0 * rolling_std AS upper_bound FROM ({eda_values}) _e"),
        "eda_points": (f"SELECT l_shipdate, total_metric, num_data_points, c AS point_class, "
                       f"CASE c WHEN 'z_score' THEN 'Z-Score Outliers' WHEN 'count' THEN 'Count-Based Outliers' "
                       f"WHEN 'metric' THEN 'Metric-Based Outliers' ELSE 'Multiple Outlier Conditions' END AS label, "
                       f"CASE c WHEN 'z_score' THEN 'red' WHEN 'count' THEN 'blue' WHEN 'metric' THEN 'green' ELSE 'purple' END AS color "
                       f"FROM (SELECT *, CASE WHEN CAST(COALESCE(is_outlier_z, false) AS INTEGER) + CAST(COALESCE(is_outlier_metric, false) AS INTEGER) "
                       f"+ CAST(COALESCE(is_outlier_count, false) AS INTEGER) > 1 THEN 'multiple' WHEN is_outlier_z THEN 'z_score' "
                       f"WHEN is_outlier_metric THEN 'metric' ELSE 'count' END AS c FROM ({O.detect_sql(ship, 'l_shipdate', EDA)}) _d "
                       f"WHERE is_outlier) _p"),
        "value_overlay": (f"SELECT CASE WHEN value IS NULL THEN variable ELSE variable || '_' || value END AS series, variable, value, o_orderdate, "
                          f"total_metric, rolling_mean, rolling_std, is_outlier FROM ({eda_values}) _e"),
        "hard_series": _hard_sql(DETECT),
        "hard_guard_before": _hard_sql(EDA_SPEC_GUARD),
        "hard_guard_none": _hard_sql(EDA),
        "view_totals": _totals_sql(day, "o_orderdate"),
    }
    if llm_queries is None:
        return own
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**own, **llm_queries.oracle_sql(), **whole}
