"""The registered queries of the operators, each over its whole table, and the
SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikewatch.llm import (fingerprints, kdtree, lm, mixing, packing, periodic_runs, pii, quality, sharding, simhash_dedup,
                            substring_dedup, toxicity, whitening)
from spikewatch.llm.common import read_documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_kdtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return kdtree.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, times=256.0)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON (q.vec_id <> c.vec_id OR q.e <> c.e) AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
) WHERE rank <= 5
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(read_documents(spark, sf_dir), shingle=3, seed=42, max_bits=3)
    return rows.select(F.col("id").alias("doc_id"), simhash_dedup.hex16(F.col("fp")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_documents(spark, sf_dir), _labels(spark, sf_dir), threshold=0.7, parts=3, kept_out=1)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprints(read_documents(spark, sf_dir), bits=256)
    near = fingerprints.with_neighbours(rows, F.col("doc_id") % 100 == 0, radius=12, blocks=13, bits=256)
    text = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return near.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next", "near_docs")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read_documents(spark, sf_dir), carry=["doc_id"])
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), _labels(spark, sf_dir), threshold=0.3, parts=5, kept_out=0)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_documents(spark, sf_dir), parts=5, kept_out=1)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(read_documents(spark, sf_dir), packing.public_bpe(), window=2048, end_id=1, with_ids=False)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read_documents(spark, sf_dir), shards=40)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return rows.select("doc.doc_id", (sharding.text_bytes(F.col("doc.text")) + 16).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8, scale=1024.0, shift=100_000)
    return rows.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"),
                       "whitened", "explained", "identity_error")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read_documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS p FROM d)
), m AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), g AS (
  SELECT w.doc_id, w.p, CASE WHEN w.p - lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) <= 50 THEN 0 ELSE 1 END AS new
  FROM w JOIN m ON w.s = m.s WHERE m.first < w.doc_id
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g) GROUP BY doc_id, run
), edges AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM spans
  UNION ALL
  SELECT d.doc_id, coalesce(max(s.b), 0), max(length(d.h)) // 2 FROM d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT e.doc_id, string_agg(substr(d.h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo) AS h
  FROM edges e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id
), sizes AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(z.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(z.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN sizes z ON d.doc_id = z.doc_id
"""


def planted_loop(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a text of ``n`` words is made to
    repeat; a row without an id is left as it is."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.periodic_runs(read_documents(spark, sf_dir), least=12, loop=planted_loop)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = rows.withColumn("best", best)
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return rows.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_kdtree_search, op2_simhash_dedup, op3_toxicity, op4_fingerprints, op5_mixing, op6_pii, op7_quality,
        op8_language_model, op9_packing, op10_sharding, op11_whitening, op12_substring_dedup, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op1_kdtree_search": OP1_SQL, "op12_substring_dedup": OP12_SQL}
