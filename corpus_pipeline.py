"""From raw documents to packed sequences: quality, near duplicates, personal
data, source mix, packing.  Each stage works on all rows that the one before
wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spikewatch.llm import mixing, packing, pii, quality, simhash_dedup
from spikewatch.llm.common import ensure_checkpoint_dir, read_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least
    0.3).  It learns from the labelled ones among ``docs``, except the fold that
    its query holds out; without any it keeps all."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by
    fingerprints at 3 or fewer differing bits (three-word shingles)."""
    return simhash_dedup.dedup(docs, shingle=3, seed=42, max_bits=3)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` updated."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (0 to 3 times)."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, packing.public_bpe(), window=2048, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and the packing order are beyond SQL; tests compare each stage
#: with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's rows written as Parquet in
    the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
