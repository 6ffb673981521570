"""Places in a total order, the report's numbering and the argmax per period,
against plain sorting."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spikewatch import AnalysisSpec
from spikewatch.operators import most_specific, period_index, ranked_findings, report_order
from spikewatch.operators.order import numbered

SPEC = AnalysisSpec("t", "m")


@pytest.mark.parametrize("ranges", [None, 1, 5, 40])
def test_places_are_those_of_a_sort(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.choice([None, "", "a", "b", "é", "zz"]), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x double, i int").repartition(7)
    got = numbered(df, [F.col("k").desc_nulls_first(), F.col("x").asc()], "place", total="n", ranges=ranges).collect()
    by = sorted(rows, key=lambda r: r[1])
    by = sorted(by, key=lambda r: (r[0] is None, (r[0] or "").encode()), reverse=True)
    # a reversed stable sort keeps the order of x within a key
    assert {(r.i, r.place) for r in got} == {(r[2], p) for p, r in enumerate(by)}
    assert {r.n for r in got} == {500} and set(got[0].asDict()) == {"k", "x", "i", "place", "n"}


def test_empty_and_single_rows(spark):
    df = spark.createDataFrame([], "t string")
    assert numbered(df, [F.col("t")], "p", total="n").collect() == []
    assert [(r.t, r.p, r.n) for r in numbered(spark.createDataFrame([("x",)], "t string"), [F.col("t")], "p", total="n").collect()] == [("x", 0, 1)]


@pytest.mark.parametrize("kind", ["string", "int", "date", "timestamp_ntz", "decimal(9,2)"])
def test_period_index_takes_any_time_type(spark, kind):
    base = {"string": "lpad(CAST(id AS STRING), 4, '0')", "date": "date_add(DATE'2020-01-01', CAST(id AS INT))",
            "timestamp_ntz": "TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT))"}.get(kind, f"CAST(id AS {kind})")
    series = spark.range(300).selectExpr(f"{base} AS t", "id").union(spark.sql(f"SELECT CAST(NULL AS {kind}), -1L")).repartition(6)
    got = period_index(series, SPEC, ranges=9).collect()
    assert sorted((r.id, r._i) for r in got) == [(i - 1, i) for i in range(301)]


def test_no_task_orders_a_whole_axis(spark):
    """Periods are dealt by range; one task sees one number per range at most."""
    from spikewatch import DETECT
    from spikewatch.operators import detect

    s = spark.range(3000).selectExpr("CAST(id AS STRING) AS t", "id * 7 % 100 AS total_units", "1L AS num_data_points")
    spec = AnalysisSpec("t", "m", metric_scale=2)
    df = detect(s, spec, DETECT, block_rows=100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    single = [part for part in plan.split("Exchange SinglePartition")[1:]]
    assert len(single) == 1 and "HashAggregate(keys=[_range" in single[0].split("Scan")[0]
    assert sorted(map(str, df.collect())) == sorted(map(str, detect(s, spec, DETECT).select(*df.columns).collect()))


FOUND = "t string, n_keys int, total_metric double, slice_ordinal int, slice_key string, anomaly_types array<string>"


def found_rows(rng, n=400):
    seen, rows = set(), []
    for _ in range(n):
        t, o = rng.choice([None, *(f"p{i}" for i in range(40))]), rng.randrange(30)
        if (t, o) not in seen:
            seen.add((t, o))
            rows.append((t, rng.randrange(3), rng.choice([None, float("nan"), 1.0, 1.0, 2.5, -3.0]), o, f"s{o}", ["z_score"][: rng.randrange(2)]))
    return rows


def test_argmax_equals_the_window(spark):
    df = spark.createDataFrame(found_rows(random.Random(8)), FOUND).repartition(6)
    by = Window.partitionBy("t")
    best = by.orderBy(F.col("n_keys").desc(), F.col("total_metric").desc(), F.col("slice_ordinal").asc())
    want = df.withColumns({"first_ordinal": F.min("slice_ordinal").over(by), "_r": F.row_number().over(best)}).where("_r = 1").drop("_r")
    got = most_specific(df, SPEC)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_report_numbers_equal_one_window(spark):
    selected = most_specific(spark.createDataFrame(found_rows(random.Random(9)), FOUND), SPEC)
    got = ranked_findings(selected, SPEC)
    whole = Window.partitionBy()
    want = selected.withColumns({"report_rank": F.row_number().over(whole.orderBy(*report_order(SPEC))), "n_blocks": F.count(F.lit(1)).over(whole)})
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ranked_findings(selected.where("false"), SPEC).collect() == []
