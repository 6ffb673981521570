"""Property test: ``detect`` with the DETECT profile against a plain-Python
restatement of the rules (SQL three-valued logic) on random series with NULL
totals, zeros and spikes."""

import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

from spikewatch import DETECT, AnalysisSpec
from spikewatch.operators import detect

SPEC = AnalysisSpec("t", "m", metric_scale=2)


def _and(*xs):
    if any(x is False for x in xs):
        return False
    return None if any(x is None for x in xs) else True


def _or(*xs):
    if any(x is True for x in xs):
        return True
    return None if any(x is None for x in xs) else False


def _cmp(a, b, op):
    return None if a is None or b is None else op(a, b)


def expected(xs):
    out = []
    n = len(xs)
    for i, x in enumerate(xs):
        win = [v for v in xs[max(0, i - 3): i + 4] if v is not None]
        mean = sum(win) / len(win) if win else None
        std = statistics.stdev(win) if len(win) > 1 else None
        z = None if std is None or x is None or mean is None else (0.0 if std == 0 else abs((x - mean) / std))
        if std == 0:
            z = 0.0
        std_g = 0.0 if mean == 0 else std
        zf = False if std_g == 0 else _cmp(z, 2.1, lambda a, b: a > b)
        prev = xs[i - 1] if i > 0 and xs[i - 1] is not None else x
        metric = _and(_or(_cmp(x, None if prev is None else 3 * prev, lambda a, b: a >= b),
                          _cmp(x, None if prev is None else 0.33 * prev, lambda a, b: a <= b)),
                      None if x is None or prev is None else abs(x - prev) > 5000)
        p = [v for v in xs[max(0, i - 3): i] if v is not None]
        q = [v for v in xs[i + 1: min(n, i + 4)] if v is not None]
        mp = sum(p) / len(p) if p else None
        mn = sum(q) / len(q) if q else None
        change = (mp is not None and mn is not None and (mn >= 2 * mp or mp >= 2 * mn) and abs(mn - mp) > 8000)
        out.append({"z": zf, "metric": metric, "change": change, "any": _or(zf, change, metric)})
    return out


values = st.one_of(st.none(), st.just(0), st.integers(0, 2000), st.integers(0, 60000))


@settings(max_examples=12, deadline=None)
@given(st.lists(values, min_size=1, max_size=40))
def test_detect_matches_python_rules(spark, xs):
    rows = [("s", i, None if v is None else v * 100, 1) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, t int, total_units bigint, num_data_points bigint")
    got = detect(df, SPEC, DETECT, ["k"]).orderBy("t").collect()
    want = expected([None if v is None else float(v) for v in xs])
    for r, w in zip(got, want):
        assert (r.is_outlier_z, r.is_outlier_metric, r.change_point, r.is_outlier) == \
            (w["z"], w["metric"], w["change"], w["any"]), (xs, r.t)
    assert all(not (isinstance(r.z_score, float) and math.isnan(r.z_score)) for r in got)
