"""A total order over many tasks: range partitions, counts per range, and places
from the sums of the counts before.

The rows are sampled for range borders, dealt into ranges and sorted inside
each; that is written to the checkpoint folder, so that the borders stay what
they are.  A row's place is its position in its range plus the rows of the
ranges before it: sums over one number per range, never over rows.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def in_ranges(df: DataFrame, order: Sequence[Column], ranges: Optional[int] = None) -> DataFrame:
    """``df`` in range partitions by ``order``, sorted inside each, written to
    the checkpoint folder.  Adds ``_range`` and ``_at``, a row's position in it."""
    by = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    ensure_checkpoint_dir(df.sparkSession)
    kept = by.sortWithinPartitions(*order).checkpoint(eager=True)
    # the id is the partition's number and, in the low 33 bits, the row's position in it
    return kept.withColumn("_id", F.monotonically_increasing_id()).selectExpr(
        "* EXCEPT (_id)", "shiftright(_id, 33) AS _range", "_id & 8589934591L AS _at")


def numbered(df: DataFrame, order: Sequence[Column], name: str, total: Optional[str] = None,
             ranges: Optional[int] = None) -> DataFrame:
    """Adds ``name``, the 0-based place of every row in ``order``, and with
    ``total`` the number of all rows.  The order should leave no ties."""
    ranged = in_ranges(df, order, ranges)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = ranged.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at"))
    if total is not None:
        out = out.withColumn(total, counts.agg(F.sum("_n")).scalar())
    return out.drop("_range", "_at", "_start")
