"""Data-quality profile (R1, A3, P3, P4): null count and type of every column.

One aggregate over the table (one partial-aggregated pass, one row out),
then the row is turned into one row per column with ``inline``.  Column types
come from the DataFrame's schema, so no extra job is needed for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def data_profile(df: DataFrame) -> DataFrame:
    """Columns: ``column_name``, ``data_type`` (Spark simple type string),
    ``null_count`` (bigint), in table column order (``ordinal`` from 0)."""
    counts = df.agg(*[
        F.sum(F.col(f"`{c}`").isNull().cast("int")).cast("bigint").alias(f"_n{i}")
        for i, c in enumerate(df.columns)
    ])
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"),
                 F.lit(dtype).alias("data_type"),
                 F.coalesce(F.col(f"_n{i}"), F.lit(0)).cast("bigint").alias("null_count"))
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame) -> DataFrame:
    """A3 as rows: ``column_name``, ``null_count``."""
    return data_profile(df).select("ordinal", "column_name", "null_count")


def type_profile(df: DataFrame) -> DataFrame:
    """P4 as rows: ``column_name``, ``data_type``, from the schema alone (no
    data column is read)."""
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"), F.lit(dtype).alias("data_type"))
               for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))
