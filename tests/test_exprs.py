"""Scalar expressions: exact %.2f text, rule names, labels."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from spikewatch.functions.exprs import (add_fixed_text, fixed_text, money_text, point_class_sql,
                                        point_label_sql, rule_names, slice_label)

TRICKY = [-0.0, 2.675, 0.125, 0.375, 100.005, -2.675, -0.125, 1.005, 0.0, 1e-9, -1e-9, 0.5, 1.5, 2.5,
          123456789.125, 32516.699999999997, 8076.729999999998, 1e12 / 3, 0.045, 0.995, 9.995]


def _check(spark, values, digits=2):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    staged = add_fixed_text(df, {"t": "x"}, digits).withColumn("u", fixed_text("x", digits))
    for r in staged.collect():
        want = f"{r.x:.{digits}f}"
        assert r.t == want, (r.x, r.t, want)
        assert r.u == want, (r.x, r.u, want)


def test_fixed_text_tricky(spark):
    _check(spark, TRICKY)
    _check(spark, TRICKY, digits=0)
    _check(spark, TRICKY, digits=3)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e11, max_value=1e11, allow_nan=False), min_size=1, max_size=60))
def test_fixed_text_matches_python(spark, xs):
    _check(spark, [x for x in xs if not math.isinf(x)])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=60))
def test_fixed_text_half_cents(spark, ks):
    # exact binary ties (k/8) and near-ties (k/200) exercise the rounding rule
    _check(spark, [k / 8 for k in ks] + [k / 200 for k in ks] + [k / 1000 for k in ks])


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = add_fixed_text(df, {"t": "x"}).withColumn("m", money_text("x")).first()
    assert row.t is None and row.m is None


def test_money_text(spark):
    df = spark.createDataFrame([(32516.699999999997,), (-2.675,)], "x double")
    assert [r.m for r in df.select(money_text("x").alias("m")).collect()] == ["$32516.70", "$-2.67"]


def test_rule_names_order_and_nulls(spark):
    df = spark.createDataFrame([(True, True, True), (None, False, True), (False, None, None)],
                               "z boolean, m boolean, c boolean")
    got = [r.n for r in df.select(rule_names("z", "m", "c").alias("n")).collect()]
    assert got == [["z_score", "metric", "change"], ["change"], []]


def test_point_class_and_label(spark):
    df = spark.createDataFrame([(["z_score"],), (["change"],), (["metric", "change"],)], "t array<string>")
    out = df.selectExpr(f"{point_class_sql('t')} AS c").selectExpr("c", f"{point_label_sql('c')} AS l").collect()
    assert [(r.c, r.l) for r in out] == [("z_score", "Z score Outliers"), ("change", "Change Point"),
                                         ("multiple", "Multiple Outliers")]


def test_slice_label(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "x string, y int")
    got = [r.k for r in df.select(slice_label(["x", "y"]).alias("k")).collect()]
    assert got == ['{"x":"a","y":"1"}', '{"y":"2"}', "all"]
