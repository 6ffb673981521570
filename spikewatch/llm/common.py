"""Helpers shared by the operators: word splitting, the checkpoint folder,
connected components and hash-threshold samples."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``), with
    A-Z lower-cased and every other byte as it is; none for NULL."""
    return text.lower().split() if text else []


def fold(key: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; NULL ids are in no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names.  Only a single-JVM
    local session without that setting (tests) gets a folder of its own; a
    cluster without it is an error, as a machine-local folder dies with its
    machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialize in the shared checkpoint folder, cutting the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``cut``, with at most ``rows`` rows of whole texts a batch sent to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, str(rows))
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, those that hold maps or variants aside."""
    return F.xxhash64(*[df[c] for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def sample_share(rows: int, bound: int) -> float:
    """The share of rows that a hash-threshold sample of about ``bound`` rows keeps."""
    return 1.0 if rows <= bound else bound / rows


def hash_below(share: float, *cols: str, seed: int) -> Column:
    """True for about ``share`` of the rows, decided by a seeded hash of ``cols``."""
    if share >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (``a``, ``b`` long):
    one row (``node``, ``component``) per node, the component named by its
    smallest node.  Alternates large-star and small-star steps: every step
    re-hangs the larger (smaller) neighbours of a node on the smallest one, so
    no neighbour list is ever gathered, the edges never grow in number, and
    rounds grow with the logarithm of the diameter."""
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        cur = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
