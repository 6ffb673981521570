"""Window statistics and rules on hand-made series, including the NULL cases."""

import math
import statistics

import pytest

from spikewatch import DETECT, EDA, SCREEN, AnalysisSpec
from spikewatch.operators import detect, rolling_columns
from spikewatch.spec import GUARD_BEFORE_Z, GUARD_NONE

SPEC = AnalysisSpec("t", "m", metric_scale=2)


def series(spark, totals, counts=None, key=None):
    counts = counts or [1] * len(totals)
    rows = [(key, i, None if v is None else int(round(v * 100)), c)
            for i, (v, c) in enumerate(zip(totals, counts))]
    return spark.createDataFrame(rows, "k string, t int, total_units bigint, num_data_points bigint")


def run(spark, totals, rules=DETECT, counts=None):
    df = detect(series(spark, totals, counts), SPEC, rules, key_cols=["k"])
    return [r.asDict() for r in df.orderBy("t").collect()]


def test_rolling_stats_match_python(spark):
    xs = [10.0, 12.5, 9.0, 30.25, 11.0, 10.5, 9.75, 12.0, 50.0, 11.5]
    rows = [r.asDict() for r in rolling_columns(series(spark, xs), SPEC, DETECT, ["k"]).orderBy("t").collect()]
    for i, r in enumerate(rows):
        win = xs[max(0, i - 3): i + 4]
        assert r["rolling_mean"] == pytest.approx(statistics.fmean(win), rel=1e-12)
        assert r["rolling_std"] == pytest.approx(statistics.stdev(win), rel=1e-12)
        prev3 = xs[max(0, i - 3): i]
        nxt3 = xs[i + 1: i + 4]
        assert r["mean_prev"] == (pytest.approx(statistics.fmean(prev3)) if prev3 else None)
        assert r["mean_next"] == (pytest.approx(statistics.fmean(nxt3)) if nxt3 else None)
        assert r["prev_total_metric"] == (xs[i - 1] if i else None)


def test_one_row_series_is_null_not_false(spark):
    (r,) = run(spark, [25.67], counts=[2])
    assert r["rolling_std"] is None and r["z_score"] is None and r["is_outlier_z"] is None
    assert r["prev_total_metric"] == 25.67 and r["prev_num_data_points"] == 2  # backfilled
    assert r["is_outlier_metric"] is False and r["change_point"] is False
    assert r["is_outlier"] is None  # NULL | false | false


def test_screening_first_row_has_no_backfill(spark):
    rows = run(spark, [100.0, 100.0, 100.0], rules=SCREEN)
    assert rows[0]["prev_total_metric"] is None and rows[0]["is_outlier_metric"] is None


def test_zero_mean_guard(spark):
    rows = run(spark, [0.0, 0.0, 0.0])
    assert all(r["rolling_std"] == 0.0 and r["z_score"] == 0.0 and r["is_outlier_z"] is False for r in rows)
    # guard after z (DETECT): z computed from the raw deviation, flag from the guarded one
    rows = run(spark, [-5.0, 5.0])
    assert rows[0]["rolling_mean"] == 0.0 and rows[0]["rolling_std"] == 0.0
    assert rows[0]["z_score"] == pytest.approx(abs(-5.0) / statistics.stdev([-5.0, 5.0]))
    assert rows[0]["is_outlier_z"] is False
    # no guard: the raw deviation stays
    rows = run(spark, [-5.0, 5.0], rules=EDA.with_(zero_mean_guard=GUARD_NONE))
    assert rows[0]["rolling_std"] == pytest.approx(statistics.stdev([-5.0, 5.0]))
    # guard before z: z becomes 0
    rows = run(spark, [-5.0, 5.0], rules=EDA.with_(zero_mean_guard=GUARD_BEFORE_Z))
    assert rows[0]["z_score"] == 0.0


def test_z_rule_needs_full_window(spark):
    # within its own n-row window a z-score cannot exceed (n-1)/sqrt(n)
    xs = [10.0] * 3 + [1000.0] + [10.0] * 3
    rows = run(spark, xs)
    assert rows[3]["z_score"] == pytest.approx(6 / math.sqrt(7))
    assert rows[3]["is_outlier_z"] is True
    edge = run(spark, [1000.0] + [10.0] * 6)
    assert edge[0]["z_score"] < 2.1 and edge[0]["is_outlier_z"] is False


def test_jump_rule_ratio_and_absolute_gate(spark):
    rows = run(spark, [10000.0, 40000.0, 41000.0, 12000.0, 12000.0, 0.0, 4000.0])
    flags = [r["is_outlier_metric"] for r in rows]
    # x >= 3 prev and diff > 5000; x <= 0.33 prev; prev = 0 -> only the gate decides
    assert flags == [False, True, False, True, False, True, False]


def _change(xs, i):
    prev, nxt = xs[max(0, i - 3): i], xs[i + 1: i + 4]
    if not prev or not nxt:
        return False
    mp, mn = statistics.fmean(prev), statistics.fmean(nxt)
    return (mn >= 2 * mp or mp >= 2 * mn) and abs(mn - mp) > 8000


def test_change_point_never_null(spark):
    xs = [1000.0, 1000.0, 1000.0, 1000.0, 30000.0, 30000.0, 30000.0, 1000.0, 1000.0]
    rows = run(spark, xs)
    got = [r["change_point"] for r in rows]
    assert got == [_change(xs, i) for i in range(len(xs))]
    assert got[0] is False and got[-1] is False and True in got


def test_null_period_total(spark):
    rows = run(spark, [10.0, None, 10.0])
    assert rows[1]["total_metric"] is None and rows[1]["is_outlier_metric"] is None
    assert rows[2]["prev_total_metric"] == 10.0  # NULL lag backfilled with the current value


def test_count_rule_eda(spark):
    rows = run(spark, [100.0] * 5, rules=EDA, counts=[5, 11, 5, 20, 40])
    assert [r["is_outlier_count"] for r in rows] == [False, True, True, True, True]
    rows = run(spark, [100.0] * 3, rules=EDA, counts=[5, 10, 4])
    assert [r["is_outlier_count"] for r in rows] == [False, False, False]


def test_partitioning_does_not_change_results(spark):
    xs = [float(v) for v in (5, 7, 3, 90, 4, 6, 5, 80, 3, 2, 60, 7)]
    a = detect(series(spark, xs), SPEC, DETECT, ["k"]).orderBy("t").collect()
    b = detect(series(spark, xs).repartition(5), SPEC, DETECT, ["k"]).orderBy("t").collect()
    assert a == b


@pytest.mark.parametrize("block", [3, 4, 7, 50])
def test_blocked_detect_equals_plain(spark, block):
    xs = [float((i * 37) % 101) * 100 + (5000 if i % 17 == 0 else 0) for i in range(120)]
    s = series(spark, xs, counts=[1 + i % 5 for i in range(120)])
    plain = detect(s, SPEC, DETECT, ["k"]).orderBy("t").collect()
    blocked = detect(s, SPEC, DETECT, ["k"], block_rows=block).orderBy("t").collect()
    assert [r.asDict() for r in plain] == [r.asDict() for r in blocked]


def test_blocked_detect_rejects_tiny_blocks(spark):
    with pytest.raises(ValueError):
        detect(series(spark, [1.0, 2.0]), SPEC, DETECT, block_rows=2)


def test_float_metric_path_matches_exact_path(spark):
    from spikewatch.operators import period_totals

    rows = [(i % 40, float((i * 7919) % 1000) / 4 + (3000 if i % 97 == 0 else 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "t int, m double")
    exact = AnalysisSpec("t", "m", metric_scale=2)
    floats = AnalysisSpec("t", "m", metric_scale=None)
    a = detect(period_totals(df, exact), exact, DETECT).orderBy("t").collect()
    b = detect(period_totals(df, floats), floats, DETECT).orderBy("t").collect()
    assert len(a) == len(b) == 40
    for x, y in zip(a, b):
        for c in ("total_metric", "rolling_mean", "rolling_std", "mean_prev", "mean_next", "z_score"):
            if x[c] is None:
                assert y[c] is None
            else:
                assert y[c] == pytest.approx(x[c], rel=1e-9, abs=1e-9)
        for c in ("is_outlier_z", "is_outlier_metric", "change_point", "is_outlier"):
            assert x[c] == y[c]


@pytest.mark.parametrize("half,span", [(3, 3), (9, 2), (2, 12), (40, 25)])
def test_running_sums_equal_neighbours(spark, monkeypatch, half, span):
    """Frames from differences of running sums, NULL totals and short slices included."""
    from spikewatch.operators import rules as R

    rows = [(k, t, None if (t * 7 + len(k)) % 11 == 0 else (t * 7919 + len(k) * 31) % 100_003 - 40_000, 1)
            for k, n in (("a", 1), ("bb", 2), ("ccc", 30), ("dddd", 130)) for t in range(n)] + [("e", t, None, 1) for t in range(5)]
    s = spark.createDataFrame(rows, "k string, t int, total_units bigint, num_data_points bigint").repartition(4)
    rules = DETECT.with_(half_window=half, shift_span=span)
    out = []
    for limit in (0, 1000):
        monkeypatch.setattr(R, "_NEIGHBOURS", limit)
        df = detect(s, SPEC, rules, ["k"])
        out.append((df.columns, sorted(map(str, df.collect()))))
    assert out[0] == out[1]


def test_wide_frames_keep_the_plan_small(spark):
    s = spark.range(50).selectExpr("'x' AS k", "CAST(id AS INT) AS t", "id AS total_units", "1L AS num_data_points")
    sizes = [len(detect(s, SPEC, DETECT.with_(half_window=h), ["k"])._jdf.queryExecution().optimizedPlan().toString()) for h in (20, 2000)]
    assert sizes[1] < sizes[0] + 200
