"""Sources and sinks: CSV scan, view, profile files, report text, series files."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import REF, SF001, needs, parts_in_order
from spikewatch import AnalysisSpec, PeriodAnomalyAnalysis, spec_from_roles
from spikewatch.operators import data_profile, null_profile, type_profile
from spikewatch.sources import (read_csv, read_series_files, read_table, register_view, write_profile,
                                write_report, write_series)


def _tmp():
    return tempfile.mkdtemp(prefix="spikewatch-test-")


def test_profile_counts_nulls_and_types(spark):
    df = spark.createDataFrame([(1, None, 2.5), (None, "b", None), (3, "c", None)],
                               "a int, b string, c double")
    rows = [tuple(r) for r in data_profile(df).orderBy("ordinal").collect()]
    assert rows == [(0, "a", "int", 1), (1, "b", "string", 1), (2, "c", "double", 2)]
    assert null_profile(df).columns == ["ordinal", "column_name", "null_count"]
    assert type_profile(df).columns == ["ordinal", "column_name", "data_type"]


def test_profile_sink_and_csv_scan(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string")
    out = os.path.join(_tmp(), "profile")
    write_profile(data_profile(df), out)
    back = read_csv(spark, out)
    assert back.columns == ["Column", "Null Count", "Data Type"]
    assert [tuple(r) for r in back.collect()] == [("a", 1, "int"), ("b", 0, "string")]


def test_read_table_options_and_view(spark):
    d = _tmp()
    p = os.path.join(d, "data.csv")
    with open(p, "w") as fh:
        fh.write("w;m;k\n2018-01;1.5;a\n2018-02;2.5;b\n")
    df = read_table(spark, p, "csv", {"header": True, "delimiter": ";"}, "w string, m double, k string")
    register_view(df, "service_data")
    assert spark.sql("SELECT sum(m) AS s FROM service_data").first().s == 4.0


def test_roles_from_config_table():
    roles = {"service_week": {"type": "string", "time_variable": True},
             "service_date": {"time_variable": False},
             "betos_cd": {"test_variable": True}, "pos_cd": {"test_variable": True},
             "paid_amount": {"metric_variable": True}}
    spec = spec_from_roles(roles)
    assert (spec.time_col, spec.metric_col, spec.test_cols) == ("service_week", "paid_amount",
                                                                ("betos_cd", "pos_cd"))
    assert spec.noun == "Weeks"
    assert AnalysisSpec("service_date", "m").noun == "Days"


@needs(SF001)
def test_report_and_series_round_trip(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    spec = AnalysisSpec("o_orderdate", "o_totalprice", ("o_orderpriority", "o_orderstatus"))
    a = PeriodAnomalyAnalysis(o, spec)
    d = _tmp()
    write_report(a.report, os.path.join(d, "report"))
    text = parts_in_order(os.path.join(d, "report"))
    want = "".join(r.value + "\n" for r in a.report.orderBy("report_rank", "line_no").collect())
    assert text == want and text.startswith("ANOMALY REPORT SUMMARY\n")

    write_series(a.detected, spec, os.path.join(d, "series"))
    names = sorted(os.listdir(os.path.join(d, "series")))
    assert "series=outliers_all" in names and len([n for n in names if n.startswith("series=")]) == 4
    back = read_series_files(spark, os.path.join(d, "series"),
                             schema=None).select("series", "o_orderdate", "total_metric")
    assert back.count() == a.detected.count()
    assert back.filter(F.col("series") == "outliers_all").count() == \
        a.detected.filter(F.col("slice_ordinal") == 0).count()


def test_config_and_job(spark):
    import yaml

    from spikewatch.plans.job import run_job
    from spikewatch.sources.config import load_config

    d = _tmp()
    data = os.path.join(d, "data.csv")
    rows = ["service_week,betos_cd,pos_cd,paid_amount"]
    for w in range(1, 30):
        for b, p, amt in (("T1H", 81, 100.0), ("T1A", 11, 50.0)):
            bump = 40000.0 if (w == 15 and b == "T1H") else 0.0
            rows.append(f"2018-{w:02d},{b},{p},{amt * w + bump}")
    with open(data, "w") as fh:
        fh.write("\n".join(rows) + "\n")
    cfg = os.path.join(d, "config.yml")
    with open(cfg, "w") as fh:
        yaml.safe_dump({"dataset": {"name": "data", "format": "csv", "delimiter": ",", "header": True},
                        "variables": {"service_week": {"type": "string", "time_variable": True},
                                      "betos_cd": {"test_variable": True},
                                      "pos_cd": {"type": "integer", "test_variable": True},
                                      "paid_amount": {"metric_variable": True}}}, fh)
    source, spec = load_config(cfg)
    assert (source.format, spec.time_col, spec.test_cols) == ("csv", "service_week", ("betos_cd", "pos_cd"))
    df = read_table(spark, data, source.format, source.options)
    out = os.path.join(d, "out")
    a = run_job(df, spec, out, materialize=True, series=True)
    assert sorted(os.listdir(os.path.join(out, "preprocessing"))) == ["data_types", "null_counts"]
    rep_dir = os.path.join(out, "service_week", "outliers_summary")
    part = [f for f in os.listdir(rep_dir) if f.startswith("part-")][0]
    with open(os.path.join(rep_dir, part)) as fh:
        text = fh.read()
    assert "Week: 2018-15" in text and "Grouping: T1H, 81" in text
    assert os.path.isdir(os.path.join(out, "service_week", "chart_points"))
    assert os.path.isdir(os.path.join(out, "EDA", "outlier_results", "series=outliers_betos_cd_T1H_pos_cd_81"))
    assert a.top_map == {"betos_cd": "T1H", "pos_cd": "81"}


def test_time_buckets_ignore_session_time_zone(spark):
    from spikewatch.operators import hour_start, week_start

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.sql("SELECT timestamp_ntz'2018-03-11 02:30:00' AS ts UNION ALL "
                       "SELECT timestamp_ntz'2018-03-05 00:00:00' UNION ALL SELECT timestamp_ntz'2018-03-04 23:59:59'")
        got = [(str(r.w), str(r.h)) for r in df.select(week_start("ts").alias("w"), hour_start("ts").alias("h"))
               .collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [("2018-03-05 00:00:00", "2018-03-11 02:00:00"),
                   ("2018-03-05 00:00:00", "2018-03-05 00:00:00"),
                   ("2018-02-26 00:00:00", "2018-03-04 23:00:00")]


@needs(SF001)
def test_value_series_sink_round_trip(spark):
    from spikewatch.operators import value_series
    from spikewatch.sources import write_value_series

    o = spark.read.parquet(f"{SF001}/orders.parquet")
    spec = AnalysisSpec("o_orderdate", "o_totalprice", ("o_orderpriority", "o_orderstatus"))
    screened = value_series(o, spec)
    out = os.path.join(_tmp(), "values")
    write_value_series(screened, spec, out)
    assert {"variable=o_orderpriority", "variable=o_orderstatus"} <= set(os.listdir(out))
    back = spark.read.option("header", "true").csv(out)
    assert back.count() == screened.count()
    assert {r.value for r in back.filter("variable = 'o_orderstatus'").select("value").distinct().collect()} == \
        {r.o_orderstatus for r in o.select("o_orderstatus").distinct().collect()}


def test_command_line_job():
    import subprocess
    import sys

    import yaml

    d = _tmp()
    data = os.path.join(d, "data.csv")
    rows = ["service_week,betos_cd,paid_amount"]
    for w in range(1, 25):
        rows += [f"2019-{w:02d},T1H,{100.0 * w + (50000.0 if w == 12 else 0.0)}", f"2019-{w:02d},T1A,{40.0 * w}"]
    with open(data, "w") as fh:
        fh.write("\n".join(rows) + "\n")
    cfg = os.path.join(d, "config.yml")
    with open(cfg, "w") as fh:
        yaml.safe_dump({"dataset": {"format": "csv", "delimiter": ",", "header": True},
                        "variables": {"service_week": {"time_variable": True}, "betos_cd": {"test_variable": True},
                                      "paid_amount": {"metric_variable": True}}}, fh)
    out = os.path.join(d, "out")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=root + os.pathsep + os.environ.get("PYTHONPATH", ""))
    res = subprocess.run([sys.executable, "-m", "spikewatch", "--config", cfg, "--data", data, "--out", out],
                         cwd=d, env=env, capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    rep = os.path.join(out, "service_week", "outliers_summary")
    text = parts_in_order(rep)
    assert text.startswith("ANOMALY REPORT SUMMARY\n") and "Week: 2019-12" in text


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_series_files_are_read_by_their_own_header(spark):
    d = _tmp()
    write(d, "a.csv", "t,x,is_a,is_b\nw01,1.5,True,False\nw02,2.5,False,True\n")
    write(d, "b 1+%[x].csv", "\ufefft,is_b,is_a,x\nw01,True,False,7\n")
    write(d, "c.csv", 'x,"t"\n3,w03\n')
    write(d, "empty.csv", "")
    write(d, "only.csv", "t,x,is_a,is_b\n")
    want = {("a", "w01", 1.5, True, False), ("a", "w02", 2.5, False, True), ("b 1+%[x]", "w01", 7.0, False, True),
            ("c", "w03", 3.0, None, None)}
    for df in (read_series_files(spark, d, "t string, x double, is_a boolean, is_b boolean"), read_series_files(spark, d),
               read_series_files(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b*.csv"), os.path.join(d, "[co]*.csv")])):
        assert {tuple(r) for r in df.select("series", F.col("t").cast("string"), F.col("x").cast("double"), "is_a", "is_b").collect()} == want
    some = read_series_files(spark, d, "is_b boolean, other int, t string")
    assert some.columns == ["is_b", "other", "t", "series"]
    assert {(r.series, r.is_b) for r in some.where("t = 'w01'").collect()} == {("a", False), ("b 1+%[x]", True)}


def test_series_files_that_disagree_on_types(spark):
    d = _tmp()
    write(d, "a.csv", "t;n;k\n1;2;3\n")
    write(d, "b.csv", "k;n;t\nx;2.5;4\n")
    df = read_series_files(spark, d, delimiter=";")
    assert dict(df.dtypes) == {"t": "int", "n": "double", "k": "string", "series": "string"}
    assert {tuple(r) for r in df.select("t", "n", "k").collect()} == {(1, 2.0, "3"), (4, 2.5, "x")}


def test_many_files_with_few_headers(spark):
    d = _tmp()
    for i in range(60):
        write(d, f"s{i:02d}.csv", f"t,a,b\n{i},1,2\n" if i % 2 else f"b,t,a\n2,{i},1\n")
    got = read_series_files(spark, d, "t int, a int, b int").collect()
    assert sorted((r.series, r.t, r.a, r.b) for r in got) == [(f"s{i:02d}", i, 1, 2) for i in range(60)]


@needs(os.path.join(REF, "EDA"))
def test_both_generations_of_series_files_in_one_call(spark):
    """The older file has its count flag before its metric flag."""
    schema = "service_week string, total_metric double, num_data_points int, is_outlier_z boolean, is_outlier_metric boolean, " \
             "is_outlier_count boolean, is_outlier boolean"
    files = [f"{REF}/EDA/outliers_all_data/weekly_outliers.csv", f"{REF}/EDA/outlier_results/outliers_all.csv"]
    import csv

    want = set()
    for f, name in zip(files, ("weekly_outliers", "outliers_all")):
        with open(f, newline="") as fh:
            want |= {(name, r["service_week"], r["is_outlier_metric"], r["is_outlier_count"]) for r in csv.DictReader(fh)}
    rows = read_series_files(spark, files, schema).collect()
    text = {None: "", True: "True", False: "False"}
    assert {(r.series, r.service_week, text[r.is_outlier_metric], text[r.is_outlier_count]) for r in rows} == want
    assert {"True", "False"} <= {w[2] for w in want} and {"True", "False"} <= {w[3] for w in want}


def test_a_long_series_beside_short_ones(spark):
    """One series a hundred times the others: pieces of a bounded size, in time
    order by file name."""
    from spikewatch.sources import write_value_series, write_value_table

    spec = AnalysisSpec("t", "m", ("code",))
    long = spark.range(2000).selectExpr("'code' AS variable", "'0/1 a%b' AS value", "CAST(id AS INT) AS t", "CAST(id AS DOUBLE) AS total_metric")
    short = spark.range(400).selectExpr("'code' AS variable", "CASE WHEN id DIV 20 = 3 THEN NULL ELSE concat('0', id DIV 20) END AS value",
                                        "CAST(id % 20 AS INT) AS t", "CAST(id AS DOUBLE) AS total_metric")
    rows = long.unionByName(short)
    want = sorted(map(str, rows.select("variable", "value", "t", "total_metric").collect()))
    out = os.path.join(_tmp(), "values")
    write_value_series(rows.repartition(5), spec, out, file_rows=300)
    back = read_series_files(spark, out, "t int, total_metric double")
    assert sorted(map(str, back.select("variable", "value", "t", "total_metric").collect())) == want
    longest = [n for n in os.listdir(os.path.join(out, "variable=code")) if n.startswith("value=0%2F1")]
    folder = os.path.join(out, "variable=code", longest[0])
    lines, files = [], sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    for f in files:
        with open(os.path.join(folder, f)) as fh:
            own = [int(r.split(",")[0]) for r in fh.read().splitlines()[1:]]
        assert len(own) <= 300
        lines += own
    assert lines == list(range(2000)) and len(files) >= 7
    table = os.path.join(_tmp(), "table")
    write_value_table(rows.repartition(5), spec, table, file_rows=300)
    assert sorted(map(str, spark.read.parquet(table).select("variable", "value", "t", "total_metric").collect())) == want
