"""Subset lattice: one scan + groupingSets equals filter-then-aggregate per
subset (the reference's 2^k plans); results do not depend on partitioning."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, needs
from spikewatch import AnalysisSpec, PeriodAnomalyAnalysis
from spikewatch.operators import period_totals, subset_series

pytestmark = needs(SF001)
TESTS = ("o_orderpriority", "c_nationkey", "c_mktsegment")
SPEC = AnalysisSpec("o_orderdate", "o_totalprice", TESTS, {"c_nationkey": "n_name"}, metric_scale=2)


def fact(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    c = spark.read.parquet(f"{SF001}/customer.parquet")
    n = spark.read.parquet(f"{SF001}/nation.parquet")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


def test_lattice_equals_filter_then_aggregate(spark):
    df = fact(spark)
    a = PeriodAnomalyAnalysis(df, SPEC)
    top = a.top_map
    assert set(top) == set(TESTS)
    lattice = a.lattice
    for j, s in enumerate(SPEC.subsets()):
        values = {TESTS[i]: (int(top[TESTS[i]]) if TESTS[i] == "c_nationkey" else top[TESTS[i]]) for i in s}
        want = {(r.o_orderdate, r.total_units, r.num_data_points)
                for r in period_totals(df, SPEC, values).collect()}
        got_df = lattice.filter(F.col("slice_ordinal") == j)
        got = {(r.o_orderdate, r.total_units, r.num_data_points) for r in got_df.collect()}
        assert got == want, s
        row = got_df.first()
        assert row.n_keys == len(s)
        for i, c in enumerate(TESTS):
            assert (getattr(row, c) is not None) == (i in s)
        assert (row.n_name is not None) == (1 in s)


def test_lattice_ignores_partitioning(spark):
    df = fact(spark)
    top = PeriodAnomalyAnalysis(df, SPEC).top_map
    a = sorted(map(tuple, subset_series(df, SPEC, top).collect()), key=str)
    b = sorted(map(tuple, subset_series(df.repartition(7, "o_orderkey"), SPEC, top).collect()), key=str)
    assert a == b


def test_missing_top_value_drops_its_subsets(spark):
    df = fact(spark)
    top = PeriodAnomalyAnalysis(df, SPEC).top_map
    partial = {k: v for k, v in top.items() if k != "c_mktsegment"}
    got = {r.slice_ordinal for r in subset_series(df, SPEC, partial).select("slice_ordinal").distinct().collect()}
    assert got == {j for j, s in enumerate(SPEC.subsets()) if 2 not in s}


def test_materialized_analysis_matches_lazy(spark):
    df = fact(spark)
    lazy = PeriodAnomalyAnalysis(df, SPEC)
    kept = PeriodAnomalyAnalysis(df, SPEC, materialize=True)
    a = sorted(map(tuple, lazy.report.collect()))
    b = sorted(map(tuple, kept.report.collect()))
    assert a == b and len(a) > 11
    assert spark.sparkContext.getCheckpointDir()


def test_most_specific_keeps_one_row_per_period(spark):
    a = PeriodAnomalyAnalysis(fact(spark), SPEC)
    sel = a.selected
    assert sel.count() == sel.select("o_orderdate").distinct().count() > 0
    # every selected slice has the most keys among the period's findings
    worse = a.found.alias("f").join(sel.alias("s"), "o_orderdate").filter(F.col("f.n_keys") > F.col("s.n_keys"))
    assert worse.count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_fewer_test_columns(spark, k):
    spec = AnalysisSpec("o_orderdate", "o_totalprice", TESTS[:k], metric_scale=2)
    a = PeriodAnomalyAnalysis(fact(spark), spec)
    assert a.lattice.select("slice_ordinal").distinct().count() == 2 ** k
    assert a.report.count() > 10


def test_top_as_dataframe_equals_collected(spark):
    df = fact(spark)
    a = PeriodAnomalyAnalysis(df, SPEC)
    lazy = sorted(map(tuple, subset_series(df, SPEC, a.top).collect()), key=str)
    lit = sorted(map(tuple, subset_series(df, SPEC, a.top_map).collect()), key=str)
    assert lazy == lit


def test_describe_values_all_unknown_and_min(spark):
    from spikewatch.operators import describe_values

    rows = spark.createDataFrame([("c", "1"), ("c", None), ("c", "9"), ("d", "x")], "variable string, value string")
    dims = spark.createDataFrame([("c", "1", "b-name"), ("c", "1", "a-name"), ("d", "y", "why")],
                                 "variable string, value string, description string")
    got = {(r.variable, r.value): r.description for r in describe_values(rows, dims).collect()}
    assert got == {("c", "1"): "a-name", ("c", None): "All", ("c", "9"): "Unknown", ("d", "x"): "Unknown"}


def test_value_totals_add_up_to_period_totals(spark):
    from spikewatch.operators import value_totals

    df = fact(spark)
    overall = {r.o_orderdate: (r.total_units, r.num_data_points) for r in period_totals(df, SPEC).collect()}
    per_var = (value_totals(df, SPEC).groupBy("variable", "o_orderdate")
               .agg(F.sum("total_units").alias("u"), F.sum("num_data_points").alias("n")).collect())
    assert len(per_var) == len(TESTS) * len(overall)
    for r in per_var:
        assert (r.u, r.n) == overall[r.o_orderdate]


@pytest.mark.parametrize("k", [5, 13, 62, 63, 70, 126])
def test_many_columns_against_filters(spark, k):
    """Every subset of what rows hold, masks of one, two and three integers."""
    from itertools import combinations
    import random

    rng = random.Random(k)
    spec = AnalysisSpec("t", "m", tuple(f"c{i}" for i in range(k)), metric_scale=0)
    rows = []
    for _ in range(60):
        held = set(rng.sample(range(k), rng.randint(0, 4))) | ({k - 1} if rng.random() < 0.3 else set())
        rows.append((rng.randint(1, 3), float(rng.randint(0, 9)), *[1 if i in held else rng.choice([None, 0, 2]) for i in range(k)]))
    df = spark.createDataFrame(rows, "t int, m double, " + ", ".join(f"c{i} int" for i in range(k)))
    want = {}
    for t, m, *values in rows:
        held = [i for i, v in enumerate(values) if v == 1]
        for n in range(len(held) + 1):
            for s in combinations(held, n):
                total, count = want.get((t, s), (0, 0))
                want[t, s] = (total + int(m), count + 1)
    top = {f"c{i}": "1" for i in range(k)}
    got = subset_series(df, spec, top).collect()
    assert {(r.t, spec.subset_at(int(r.slice_ordinal))): (r.total_units, r.num_data_points) for r in got} == want
    for r in got:
        s = spec.subset_at(int(r.slice_ordinal))
        assert r.n_keys == len(s) and all((r[f"c{i}"] == 1) == (i in s) for i in range(k))
    some = sorted({int(r.slice_ordinal) for r in got})[1::7]
    part = subset_series(df, spec, top, wanted=some).collect()
    assert sorted(map(str, part)) == sorted(str(r) for r in got if int(r.slice_ordinal) in some)


def test_subsets_by_number():
    spec = AnalysisSpec("t", "m", tuple("abcdefg"))
    assert [spec.subset_at(j) for j in range(spec.n_subsets())] == spec.subsets()
    wide = AnalysisSpec("t", "m", tuple(f"c{i}" for i in range(100)))
    assert wide.subset_at(0) == () and wide.subset_at(100) == (99,) and wide.subset_at(101) == (0, 1) and len(wide.subset_at((1 << 100) - 1)) == 100
    with pytest.raises(ValueError):
        spec.subset_at(128)


def test_facts_are_scanned_once(spark):
    """Descriptions and the unsliced series come from the pre-aggregated facts."""
    table = fact(spark)
    a = PeriodAnomalyAnalysis(table, SPEC)

    def fact_scans(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return sum("Scan parquet" in line and "o_totalprice" in line for line in plan.splitlines())

    # of the lattice, one scan is in the description's subquery, whose exchange the totals read
    assert fact_scans(a.lattice) <= 1
    assert [fact_scans(df) for df in (a.points(), a.axis())] == [1, 1]


def test_points_equal_the_join(spark):
    from spikewatch.plans import chart

    a = PeriodAnomalyAnalysis(fact(spark), SPEC)
    joined = chart.chart_points(a.selected, a.base, SPEC)
    got = a.points()
    assert got.columns == joined.columns and sorted(map(str, got.collect())) == sorted(map(str, joined.collect()))
    joined = chart.reported_axis(a.base, a.selected, SPEC)
    got = a.axis()
    assert sorted(got.columns) == sorted(joined.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, joined.select(*got.columns).collect()))
