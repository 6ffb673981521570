"""Sinks: profile CSVs (S5, S6), the text report (S7), per-slice series."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q, series_name
from ..spec import AnalysisSpec


def profile_rows(profile: DataFrame) -> DataFrame:
    """The profile under the headers of its files: ``Column,Null Count,Data Type``."""
    return profile.select(F.col("column_name").alias("Column"),
                          *[F.col(c).alias(n) for c, n in (("null_count", "Null Count"), ("data_type", "Data Type"))
                            if c in profile.columns])


def write_profile(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The profile (a handful of rows, one per column) as one CSV file."""
    profile_rows(profile.repartition(1).sortWithinPartitions("ordinal")).write.mode(mode).option("header", "true").csv(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The report lines as text, in ranges of the report written in
    parallel: the part files one after the other, in the order of their names,
    are the report."""
    order = [F.col("report_rank"), F.col("line_no")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode(mode).text(path)


def _write_series(named: DataFrame, folders: Sequence[str], time_col: str, path: str, mode: str, file_rows: int) -> None:
    order = [F.col(q(c)).asc_nulls_first() for c in (*folders, time_col)]
    writer = named.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode) \
        .option("header", "true").option("maxRecordsPerFile", str(file_rows))
    writer.partitionBy(*folders).csv(path)


def write_series(detected: DataFrame, spec: AnalysisSpec, path: str, mode: str = "overwrite", file_rows: int = 1_000_000) -> None:
    """Every lattice series as CSV, one directory per series
    (``series=outliers_<var>_<value>...``).

    The rows are range-partitioned by (series, time): a task writes many short
    series or a piece of a long one, whose files of at most ``file_rows`` rows
    are in time order by name, as are the rows in each."""
    _write_series(detected.withColumn("series", series_name(spec.test_cols)), ["series"], spec.time_col, path, mode, file_rows)


def write_value_series(screened: DataFrame, spec: AnalysisSpec, path: str, mode: str = "overwrite", file_rows: int = 1_000_000) -> None:
    """S8 for the per-value series (screening output): one directory per
    dimension and value (``variable=<column>/value=<code>``), written as
    ``write_series`` does.  That is one directory per value, for dimensions of
    modest cardinality; for high-cardinality codes use ``write_value_table``."""
    _write_series(screened, ["variable", "value"], spec.time_col, path, mode, file_rows)


def write_value_table(screened: DataFrame, spec: AnalysisSpec, path: str, mode: str = "overwrite", file_rows: int = 1_000_000) -> None:
    """The per-value series as one directory per dimension, the value a column:
    files sorted by (value, time), however many values there are."""
    order = [F.col(q(c)).asc_nulls_first() for c in ("variable", "value", spec.time_col)]
    screened.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode) \
        .option("maxRecordsPerFile", str(file_rows)).partitionBy("variable").parquet(path)
