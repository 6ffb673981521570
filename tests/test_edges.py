"""Edge cases: NULL dimension values and metrics, empty input."""

from spikewatch import DETECT, AnalysisSpec, PeriodAnomalyAnalysis
from spikewatch.operators import value_totals
from spikewatch.plans.report import header_lines

SPEC = AnalysisSpec("week", "amount", ("code", "place"), metric_scale=2)


def _fact(spark, rows):
    return spark.createDataFrame(rows, "week string, amount double, code string, place int")


def test_null_values_and_metrics(spark):
    rows = []
    for w in range(1, 25):
        rows += [(f"2020-{w:02d}", 100.0 * w, "A", 1), (f"2020-{w:02d}", None, None, 2),
                 (f"2020-{w:02d}", 50.0 + (30000.0 if w == 12 else 0.0), "B", None)]
    df = _fact(spark, rows)
    vt = {(r.variable, r.value): r for r in value_totals(df, SPEC).filter("week = '2020-05'").collect()}
    assert vt[("code", None)].total_units is None and vt[("code", None)].num_data_points == 1
    assert vt[("place", None)].total_units == 5000 and vt[("place", "2")].total_units is None
    a = PeriodAnomalyAnalysis(df, SPEC)
    top = a.top_map
    assert None not in top.values() and set(top) == {"code", "place"}
    lat = a.lattice
    # NULL codes never match a top value: the full subset only sees matching rows
    full = lat.filter("n_keys = 2").collect()
    assert all(r.code == top["code"] and str(r.place) == top["place"] for r in full)
    assert a.report.count() >= len(header_lines(2.1)) + 1


def test_empty_input_gives_header_only(spark):
    df = _fact(spark, [])
    a = PeriodAnomalyAnalysis(df, SPEC)
    assert a.top_map == {}
    lines = [r.value for r in a.report.orderBy("report_rank", "line_no").collect()]
    assert lines == header_lines(2.1) + [""]


def test_role_projection_and_detect_slice(spark):
    from pyspark.sql import functions as F

    from spikewatch import DETECT
    from spikewatch.operators import detect, detect_slice, period_totals, role_projection

    rows = [(f"2020-{w:02d}", float(w * 10), "A" if w % 2 else "B", w % 3) for w in range(1, 30)]
    df = _fact(spark, rows)
    proj = role_projection(df, SPEC)
    assert proj.columns == ["week", "total_metric", "code", "place"]
    one = detect_slice(df, SPEC, DETECT, {"code": "A", "place": None})
    want = detect(period_totals(df.filter(F.col("code") == "A"), SPEC), SPEC, DETECT)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect()))


def test_spec_validation():
    import pytest

    with pytest.raises(ValueError):
        AnalysisSpec("week", "amount", ("week",))
    with pytest.raises(ValueError):
        AnalysisSpec("week", "amount", ("code", "code"))
    with pytest.raises(ValueError):
        AnalysisSpec("week", "amount", ("code",), {"place": "place_desc"})
    with pytest.raises(ValueError):
        AnalysisSpec("week", "amount", metric_scale=9)
    assert [s for s in AnalysisSpec("w", "m", ("a", "b", "c")).subsets()] == \
        [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def test_ruleset_validation():
    import pytest

    from spikewatch import DETECT

    with pytest.raises(ValueError):
        DETECT.with_(half_window=0)
    with pytest.raises(ValueError):
        DETECT.with_(zero_mean_guard="sometimes")
    with pytest.raises(ValueError):
        DETECT.with_(shift_ratio=0.0)
    assert DETECT.with_(z_cut=None).z_cut is None


def test_chart_helpers(spark):
    from pyspark.sql import functions as F

    from spikewatch import DETECT, EDA
    from spikewatch.operators import detect
    from spikewatch.plans import chart

    rows = [("s", i, (100000 if i in (10, 20) else 1000 + i) * 100, 5 + (30 if i == 15 else 0)) for i in range(30)]
    series = spark.createDataFrame(rows, "k string, t int, total_units bigint, num_data_points bigint")
    spec = AnalysisSpec("t", "m", metric_scale=2)
    det = detect(series, spec, DETECT, ["k"])
    b = chart.bands(det, DETECT, width=1.5).filter("t = 5").first()
    assert b.lower_bound == b.rolling_mean - 1.5 * b.rolling_std
    assert b.upper_bound == b.rolling_mean + 1.5 * b.rolling_std
    eda = detect(series, spec, EDA, ["k"])
    hits = chart.flag_filter(eda, "is_outlier_count").select("t").collect()
    assert {r.t for r in hits} == {15, 16}
    multi = chart.multi_rule(eda, ["is_outlier_z", "is_outlier_metric", "is_outlier_count"], min_rules=2)
    assert all(r.n_rules >= 2 for r in multi.collect())
    lat = det.withColumns({"slice_ordinal": F.lit(0), "slice_key": F.lit("all")})
    ov = chart.overlay(lat, AnalysisSpec("t", "m", ("k",)), ordinals=[0])
    assert ov.columns == ["series", "t", "total_metric", "rolling_mean", "rolling_std", "is_outlier"]
    assert ov.count() == 30


def test_lattice_of_thirteen_test_columns(spark):
    """Every subset of the matching columns, ordinals as in spec.subsets()."""
    from spikewatch.operators import subset_series

    cols = [f"c{i}" for i in range(13)]
    df = spark.createDataFrame([tuple(["w", 1.0] + ["x" if i in (0, 3, 12) else "y" for i in range(13)])],
                               ", ".join(["week string", "amount double"] + [f"{c} string" for c in cols]))
    spec = AnalysisSpec("week", "amount", cols)
    rows = subset_series(df, spec, {c: "x" for c in cols}).collect()
    place = {s: j for j, s in enumerate(spec.subsets())}
    want = sorted(place[s] for s in [(), (0,), (3,), (12,), (0, 3), (0, 12), (3, 12), (0, 3, 12)])
    assert sorted(r.slice_ordinal for r in rows) == want
    for r in rows:
        inside = tuple(i for i in range(13) if r[f"c{i}"] is not None)
        assert place[inside] == r.slice_ordinal and r.n_keys == len(inside) and r.total_units == 1


def test_the_metric_is_summed_as_given(spark):
    import math

    import pytest

    from spikewatch.operators import period_totals

    small = spark.createDataFrame([("a", 0.004)] * 1000 + [("n", float("nan")), ("n", 1.0), ("i", float("inf")), ("z", None)], "w string, m double")
    got = {r.w: r.total_units for r in period_totals(small, AnalysisSpec("w", "m")).collect()}
    assert got["a"] == pytest.approx(4.0) and math.isnan(got["n"]) and got["i"] == float("inf") and got["z"] is None
    big = spark.createDataFrame([("a", 9007199254740993), ("a", 1)], "w string, m bigint")
    assert int(period_totals(big, AnalysisSpec("w", "m")).first().total_units) == 9007199254740994
    exact = small.selectExpr("w", "CAST('90071992547409.93' AS DECIMAL(18,2)) AS m").limit(1)
    assert str(period_totals(exact, AnalysisSpec("w", "m")).first().total_units) == "90071992547409.93"
    assert int(period_totals(exact, AnalysisSpec("w", "m", metric_scale=2)).first().total_units) == 9007199254740993
    for bad in (0.004, float("nan"), float("inf"), 1e17):
        one = spark.createDataFrame([("a", bad)], "w string, m double")
        with pytest.raises(Exception, match="exact multiple"):
            period_totals(one, AnalysisSpec("w", "m", metric_scale=2)).collect()


def test_one_sided_jumps_and_null_periods(spark):
    from spikewatch.operators import detect

    s = spark.createDataFrame([(None, 5000.0)] + [(f"p{i:02d}", 10000.0 if i != 9 else 100.0) for i in range(20)], "t string, total_units double") \
        .selectExpr("t", "CAST(total_units AS BIGINT) AS total_units", "1L AS num_data_points")
    rules = DETECT.with_(jump_up=None, jump_down=0.5, jump_min_abs=10.0)
    spec = AnalysisSpec("t", "m", metric_scale=2)
    plain = detect(s, spec, rules)
    assert [r.t for r in plain.where("is_outlier_metric").collect()] == ["p09"]
    blocked = detect(s, spec, rules, block_rows=5)
    assert sorted(map(str, plain.collect())) == sorted(map(str, blocked.select(*plain.columns).collect()))


def test_slice_keys_never_collide(spark):
    from spikewatch.functions.exprs import slice_label

    df = spark.createDataFrame([("x, b=y", None), ("x", "y")], "a string, b string").select(slice_label(["a", "b"]).alias("k"))
    assert [r.k for r in df.collect()] == ['{"a":"x, b=y"}', '{"a":"x","b":"y"}']
