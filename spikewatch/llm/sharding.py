"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded
hash.  Pass two takes one bucket at a time, shuffles it in memory (Spark's
``shuffle`` is the Fisher-Yates algorithm) and writes it: the shuffled buckets,
one after the other, are one random order of all rows, which is cut into
shards whose numbers of rows differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikewatch.llm.common import cut, row_hash

#: Buckets whose counts are added up in one task of the prefix sum.
BLOCK = 4096
#: Copies of a row that one task numbers.
COPIES = 1 << 14
#: Common rows whose hashes are broadcast; more of them are joined by shuffle.
FEW = 100_000


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(``bucket``, ``first``): rows in the buckets before, from (``bucket``,
    ``n``), summed by blocks of buckets first."""
    blocks = counts.groupBy(F.floor(F.col("bucket") / BLOCK).alias("block")).agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = counts.withColumn("block", F.floor(F.col("bucket") / BLOCK)).withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(starts, "block").select("bucket", (F.col("base") + F.col("inner")).alias("first"))


def _by_draw(a: Column, b: Column) -> Column:
    return F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1).otherwise(0)


def numbered_copies(rows: DataFrame, key: str, share: int) -> DataFrame:
    """``rows``, one of (``doc``, ``bytes``, ``key``, ``copy``) each.  Rows that agree
    in every column and whose copies hold more than ``share`` bytes are counted
    before the shuffle and dealt out again as numbered copies; all others are
    copy 0 of themselves."""
    common = cut(rows.groupBy(key).agg(F.sum("bytes").alias("held"), F.max("bytes").alias("one"))
                 .where((F.col("held") > share) & (F.col("held") > F.col("one"))).select(key))
    found = common.count()
    if not found:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    common = F.broadcast(common) if found <= FEW else common
    alone = rows.join(common, key, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    counted = rows.join(common, key, "left_semi").groupBy("doc", "bytes", key).agg(F.count("*").alias("n"))
    last = F.least(F.col("n"), F.col("first") + COPIES) - 1
    spread = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))) \
        .repartition(key, "first").withColumn("copy", F.explode(F.sequence(F.col("first"), last)))
    return alone.select("doc", "bytes", key, "copy").union(spread.select("doc", "bytes", key, "copy"))


def shard(docs: DataFrame, shards: int = 40, *, text_col: str = "text", bucket_bytes: int = 8 << 20, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (the row as a struct), ``shard``
    (0 to ``shards`` - 1) and ``slot``, its gapless place in the shard from 0.
    Shards' numbers of rows differ by at most one.  The order depends on the
    rows, the seed and the number of buckets alone, so reruns agree.

    NULL and empty texts are rows like any other, as are rows with the same or
    a NULL id.  The copies of a row that agrees with others in every column are
    numbered and scattered one by one where together they would crowd a bucket.
    An empty table gives no rows; names of extra columns do not matter."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                       (text_bytes(docs[text_col]) + 64).alias("bytes"), row_hash(docs).alias("same"))
    total = rows.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).first()
    n, buckets = total["rows"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    scattered = numbered_copies(rows, "same", max(bucket_bytes // 8, 1)) \
        .withColumn("draw", F.xxhash64(F.lit(seed), "same", "copy")) \
        .withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("long"))
    starts = bucket_starts(cut(scattered.groupBy("bucket").agg(F.count("*").alias("n"))))
    # pass one: every bucket whole in one place, its rows in a fixed order
    parts = max(1, min(buckets, n, 100_000))  # a bucket each, no more than there are rows
    gathered = scattered.withColumn("part", F.pmod("bucket", F.lit(parts)).cast("int")).repartitionById(parts, "part") \
        .groupBy("part", "bucket").agg(F.collect_list(F.struct("draw", "doc")).alias("held"))
    held = gathered.select("bucket", F.array_sort("held", _by_draw).alias("held")).sortWithinPartitions("bucket")
    # pass two: Fisher-Yates in each bucket
    mixed = held.select("bucket", F.shuffle("held", seed).alias("held"))
    placed = mixed.join(starts, "bucket").select("first", F.posexplode("held").alias("place", "row"))
    at = F.col("first") + F.col("place")
    base, extra = divmod(n, shards)  # the first ``extra`` shards hold one row more
    number = F.when(at < extra * (base + 1), F.floor(at / (base + 1))).otherwise(
        extra + F.floor((at - extra * (base + 1)) / max(base, 1)))
    first_of = number * base + F.least(number, F.lit(extra))
    return placed.select("row.doc", number.cast("int").alias("shard"), (at - first_of).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows of ``shard()`` as Parquet, one folder per shard, ``slot`` kept."""
    sharded.select("doc.*", "slot", "shard").write.partitionBy("shard").parquet(path)
