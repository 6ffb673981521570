import itertools
import re

import numpy as np
import pytest
from cases import none, odd  # noqa: F401
from conftest import SF01, needs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spikewatch.llm import mixing


def plain_targets(sizes, weights):
    sizes, left, target, free = list(sizes), float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.shared_targets(np.array(sizes), np.array(weights))
    assert got == pytest.approx(plain_targets(sizes, weights), rel=1e-9, abs=1e-6)
    assert got.sum() == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes))


@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 25), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
@settings(max_examples=200, deadline=None)
def test_subset_sum_is_nearest(gap, pairs):
    sizes, spare = [s for s, _ in pairs], [n for _, n in pairs]
    taken = mixing.subset_sum(gap, sizes, spare)
    assert all(0 <= t <= n for t, n in zip(taken, spare))
    sums = {sum(a * b for a, b in zip(sizes, c)) for c in itertools.product(*[range(n + 1) for n in spare])}
    got = sum(a * b for a, b in zip(sizes, taken))
    assert got in sums and abs(got - gap) == min(abs(s - gap) for s in sums)


def test_wide_gaps_are_narrowed():
    sizes, counts = np.array([1, 7, 300_000, 500_001]), np.array([50, 50, 40, 40])
    total = int((sizes * counts).sum())
    for share in (0.1, 0.37, 0.99, 1.4, 3.0):
        repeats, more = mixing.fit_budget(share * total, sizes, counts)
        assert (more >= 0).all() and (more <= counts).all() and repeats + (more > 0).max() <= 3
        assert abs(repeats * total + (more * sizes).sum() - share * total) < 300_000


def check(rows, docs, slack):
    """``rows``: (doc_id, source, size, source_size, target, copies)"""
    names = sorted({s for _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    want = plain_targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, t in zip(names, want):
        own = [r for r in rows if r[1] == s]
        assert all(r[3] == size[s] and r[4] == pytest.approx(t) for r in own)
        assert all(0 <= r[5] <= 3 for r in own)
        assert abs(sum(r[2] * r[5] for r in own) - t) <= slack(own)


@pytest.mark.parametrize("part_rows", [20_000, 2])
def test_odd_rows(odd, none, part_rows, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    mixed = mixing.mix(odd, carry=["doc_id", "source", "text"])
    rows = [(r.doc.doc_id, r.doc.source, r["size"], r.source_size, r.target, r.copies, r.doc.text) for r in mixed.collect()]
    assert len(rows) == odd.count()
    for r in rows:
        assert r[2] == len(re.findall(r"[^\x20\x09-\x0D]+", r[6] or ""))
    check(rows, [(r.doc_id, r.source) for r in odd.collect()], lambda own: max(r[2] for r in own))
    again = [(r.doc.doc_id, r.doc.source, r["size"], r.source_size, r.target, r.copies, r.doc.text) for r in
             mixing.mix(odd.repartition(5), carry=["doc_id", "source", "text"]).collect()]
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(none).collect() == [] and mixing.mixed_rows(none).collect() == []


def test_rows_repeat_as_often_as_taken(odd):
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns
    copies = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert out.count() == copies


def test_equal_sizes_in_parts(spark, monkeypatch):
    """One source, one size: parts of the draw are ranked apart, the sum is exact."""
    monkeypatch.setattr(mixing, "PART_ROWS", 10)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
                                    F.when(F.col("id") < 900, "hot").otherwise("x").alias("source"))
    rows = [(r.doc.doc_id, r.doc.source, r["size"], r.source_size, r.target, r.copies) for r in mixing.mix(docs).collect()]
    check(rows, [(r[0], r[1]) for r in rows], lambda own: 2)
    assert len(rows) == 1000


@needs(SF01)
def test_targets_are_met_on_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = [(r.doc.doc_id, r.doc.source, r["size"], r.source_size, r.target, r.copies) for r in mixing.mix(docs, ["doc_id", "source"]).collect()]
    check(rows, [(r[0], r[1]) for r in rows], lambda own: 1)
