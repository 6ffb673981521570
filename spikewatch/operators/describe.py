"""Code descriptions: the dimension table (A5) and the code -> text lookup.

The analysis itself takes the description of each top value from the subset
lattice (``lattice.subset_series``).  These operators serve the general case:
describing any (variable, value) rows, e.g. screening output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import AnalysisSpec


def code_descriptions(df: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """A5: distinct (variable, value, description) rows of every described
    test column.  Hash aggregation on the keys only (map-side distinct), so
    the shuffle carries each distinct pair at most once per map task."""
    described = [c for c in spec.test_cols if c in spec.desc_cols]
    if not described:
        raise ValueError("the spec has no description columns")
    entries = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"),
                        F.col(spec.desc_cols[c]).cast("string").alias("description"))
               for c in described]
    return df.select(F.inline(F.array(*entries))).distinct()


def describe_values(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """Add ``description`` to rows with (variable, value): ``All`` when
    the value is NULL (rolled up), ``Unknown`` when the code is not in the
    dimension, else the smallest description of the code.

    ``dims`` is ``code_descriptions`` output, reduced to one row per code
    first.  No broadcast hint: the number of distinct codes is data-dependent,
    so Spark chooses the join from the measured sizes (and broadcasts only
    under ``spark.sql.autoBroadcastJoinThreshold``)."""
    one = dims.groupBy("variable", "value").agg(F.min("description").alias("_desc"))
    out = rows.join(one, ["variable", "value"], "left")
    return out.withColumn(
        "description",
        F.when(F.col("value").isNull(), F.lit("All")).otherwise(F.coalesce(F.col("_desc"), F.lit("Unknown"))),
    ).drop("_desc")
