import hashlib

import pytest
import xxhash
from cases import none, odd  # noqa: F401
from conftest import SF001
from pyspark.sql import functions as F

from spikewatch.llm import fingerprints as fp
from spikewatch.llm.queries import op4_fingerprints


def in_order(rows):
    def draw(text):
        h = xxhash.xxh64(text.encode(), seed=42).intdigest()
        return h - (1 << 64) if h >> 63 else h
    return sorted(((n, t or "") for n, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, draw(r[1]), r[1]))


def expected(rows):
    make, out = fp.Fingerprinter(256), []
    rows = in_order(rows)
    for i, (name, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, other = make.of(text.encode()), make.of(edited.encode())
        out.append((name, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), other.hex(),
                    round(fp.likeness(own, other), 9), round(fp.likeness(own, make.of(after.encode())), 9)))
    return sorted(out, key=str)


def rounded(df):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint).hex(), bytes(r.edited_fingerprint).hex(),
                    round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()], key=str)


@pytest.mark.parametrize("parts", ["1", "7", "60"])
def test_odd_rows_over_any_ranges(spark, odd, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rounded(fp.fingerprints(odd)) == expected([(r.doc_id, r.text) for r in odd.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_single_and_no_document(spark, odd, none):
    assert fp.fingerprints(none).collect() == []
    one = odd.where("doc_id = 3")
    assert rounded(fp.fingerprints(one)) == expected([(r.doc_id, r.text) for r in one.collect()])


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = op4_fingerprints(spark, SF001).collect()
    want = {r[0]: r for r in expected(docs)}
    assert len(rows) == len(docs)
    near = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id][1:5]
        others = sum((near[r.doc_id] ^ x).bit_count() <= 12 for x in near.values()) - 1
        assert r.near_docs == (others if r.doc_id % 100 == 0 else None)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def test_likeness_and_equal_texts():
    make = fp.Fingerprinter(256)
    text = ("some words of a text that goes on for a while " * 3).encode()
    assert make.of(text) == fp.Fingerprinter(256).of(text) and make.of(b" \n") == bytes(32)
    assert fp.likeness(make.of(text), make.of(text)) == 1 and fp.likeness(make.of(text), bytes(32)) < 0.4
    assert fp.likeness(bytes(32), b"\xff" * 32) == 0


def test_block_tables_lose_no_pair(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    fps = [bytes(rng.integers(0, 256, 8, dtype=np.uint8)) for _ in range(40)]
    for f in fps[:30]:
        for flips in (1, 2, 3, 4, 5):
            x = int.from_bytes(f)
            for bit in rng.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            fps.append(x.to_bytes(8))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp binary")
    for radius, blocks in ((3, 4), (2, 4), (1, 4)):
        got = {(bytes(r["query"]), bytes(r.fp)) for r in fp.within(df, df.select(F.col("fp").alias("query")), radius, blocks, 64).collect()}
        want = {(a, b) for a in fps for b in fps if (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= radius}
        assert got == want
    with pytest.raises(ValueError):
        fp.within(df, df.select(F.col("fp").alias("query")), 3, 3, 64)


def test_near_copies_with_edited_words_are_counted(spark, tmp_path):
    import random
    rng = random.Random(2)
    rows = []
    for i in range(30):
        own = [f"w{rng.randrange(5000)}" for _ in range(700)]
        copy = list(own)
        for at in (150, 500):
            copy[at] = "edited"
        rows += [(100 * i, " ".join(own)), (100 * i + 1, " ".join(copy))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    make = fp.Fingerprinter(256)
    at = {n: int.from_bytes(make.of(t.encode())) for n, t in rows}
    differ = [(at[100 * i] ^ at[100 * i + 1]).bit_count() for i in range(30)]
    assert sum(7 < d <= 12 for d in differ) > 5
    near = {r.doc_id: r.near_docs for r in op4_fingerprints(spark, str(tmp_path)).collect()}
    assert [near[100 * i] for i in range(30)] == [int(d <= 12) for d in differ]
    assert sum(near[100 * i] for i in range(30)) >= 24
