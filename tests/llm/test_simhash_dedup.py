import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import none, odd  # noqa: F401
from conftest import SF001
from spikewatch.llm import simhash_dedup as sd
from spikewatch.llm.common import components
from spikewatch.llm.queries import op2_simhash_dedup


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not own:
        return 0
    runs = [" ".join(own[i:i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[root(b)] = root(a)
    return {f: root(f) for f in fps}


def expected(rows):
    """{(id, text): (hex, component)}"""
    fp = {r: plain_fingerprint(r[1]) for r in rows}
    group = plain_components(sorted(set(fp.values())))
    low = {}
    for (name, _), f in fp.items():
        if name is not None:
            low[group[f]] = min(low.get(group[f], name), name)
    return {r: (f"{f:016x}", low.get(group[f])) for r, f in fp.items()}


def test_odd_rows_match_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = expected(list(dict.fromkeys(rows)))
    got = sd.near_duplicates(odd, carry=(odd["text"].alias("t"),)).select("id", "t", sd.hex16(F.col("fp")), "component").collect()
    assert len(got) == len(rows)
    assert all(want[(r[0], r[1])] == (r[2], r[3]) for r in got)


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = expected([(r.doc_id, r.text) for r in docs])
    got = op2_simhash_dedup(spark, SF001).collect()
    text = {r.doc_id: r.text for r in docs}
    assert len(got) == len(docs)
    assert all(want[(r.doc_id, text[r.doc_id])] == (r.fingerprint, r.component_id) for r in got)


@pytest.mark.parametrize("limit", [None, 40])
def test_links_of_crowded_buckets(spark, limit):
    """Random walks of bit flips make dense and long components; a small limit
    sends their buckets through the finer cuts and the block pairs."""
    rng = np.random.default_rng(1)
    fps = set(int(x) for x in rng.integers(0, 1 << 63, 60))
    for centre in list(fps)[:3]:
        for _ in range(400):
            walker = centre
            for bit in rng.integers(0, 64, int(rng.integers(1, 6))):
                walker ^= 1 << int(bit)
            fps.add(walker)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = sd.near_links(spark.createDataFrame(signed, "fp long"), 3, limit or 4096)
    assert links.where(F.bit_count(F.expr("a ^ b")) > 3).isEmpty()
    found = {r.node: r.component for r in components(links).collect()}
    want = plain_components(fps)
    names = {}
    for f, (s,) in zip(fps, signed):
        assert names.setdefault(found.get(s, s), want[f]) == want[f]
    assert len(names) == len(set(want.values()))


def test_segments_leave_one_bit_at_most():
    for bits in range(0, 8):
        assert len(sd.segments(bits)) * 2 > bits and sum(w for _, w in sd.segments(bits)) == 64


def test_dedup_keeps_one_row_of_each_component(spark, odd):
    kept = sd.dedup(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = plain_components(sorted({plain_fingerprint(t) for _, t in rows}))
    want = {groups[plain_fingerprint(t)] for _, t in rows}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(want) and {groups[plain_fingerprint(t)] for _, t in got} == want
    assert (1, rows[1][1]) in got and all(r[0] != 100 for r in got)
    assert [r for r in got if r[1] == "x"] == [(105, "x")]


def test_empty_table(none):
    assert sd.near_duplicates(none).collect() == [] and sd.dedup(none).collect() == []
