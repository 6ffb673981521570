import numpy as np
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from spikewatch.llm import whitening
from spikewatch.llm.queries import op11_whitening


@given(st.lists(st.lists(st.integers(-(1 << 62), 1 << 62), min_size=3, max_size=3), min_size=1, max_size=150), st.sampled_from([1, 40, 62]))
@settings(max_examples=60, deadline=None)
def test_scatter_is_exact(rows, bits):
    x = np.array(rows, np.int64) >> (63 - bits)
    total = whitening.Scatter(3)
    total.add(x[:70])
    if len(x) > 70:
        total.add(x[70:])
    big = x.astype(object)
    assert total.n == len(x) and (total.p == big.T @ big).all() and (total.s == big.sum(axis=0)).all()


def plain(vectors, components=8):
    """(n, deviations, eigenvalues, trace, covariance's matrix, centred rows) in whole numbers and doubles."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dims)]
    d = np.array([[n * r[j] - s[j] for j in range(dims)] for r in x], object)
    cov = np.array([[float(sum(a * b for a, b in zip(d[:, i], d[:, j]))) / n ** 3 for j in range(dims)] for i in range(dims)])
    return n, [int(sum(t * t for t in r)) for r in d], cov, (d / n).astype(float)


def check(rows, vectors, ids, components=8):
    n, deviation, cov, centred = plain(vectors)
    e = np.linalg.eigvalsh(cov)[::-1]
    by = {}
    for r in rows:
        by.setdefault(r.component, {}).setdefault(r[0], []).append(r)
    assert sorted(by) == list(range(1, min(components, int((e > e[0] * 1e-11).sum())) + 1))
    w = np.array([[by[c][i][0].whitened for c in sorted(by)] for i in ids])
    assert np.abs(w.T @ w / n - np.outer(w.mean(0), w.mean(0)) - np.eye(len(by))).max() < 1e-9
    for k, c in enumerate(sorted(by)):
        # the axis that the column is a projection on is an eigenvector
        axis, *_ = np.linalg.lstsq(centred, w[:, k] * np.sqrt(e[k]), rcond=None)
        assert np.abs(cov @ axis - e[k] * axis).max() < 1e-8 * e[0] and abs(np.linalg.norm(axis) - 1) < 1e-8
    for r in rows:
        assert r.n == n and r.deviation == deviation[ids.index(r[0])]
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-10 and r.identity_error < 1e-10


def test_query(spark):
    table = spark.read.parquet(f"{SF001}/embeddings.parquet").collect()
    rows = op11_whitening(spark, SF001)
    assert rows.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    good = [r for r in table if r.embedding is not None]
    got = rows.collect()
    assert len(got) == 8 * len(good)
    check(got, [r.embedding for r in good], [r.vec_id for r in good])


SCHEMA = "vec_id long, embedding array<double>, id string, vector int, n long, component int, dims int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3, 4) for i, v in rows], SCHEMA)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=4) * (i + 1)).tolist()) for i in range(30)]
    bad = [(40, None), (41, []), (42, [1.0, None, 0.0, 2.0]), (43, [float("nan"), 0.0, 0.0, 0.0]), (44, [0.0, 0.0, float("-inf"), 1.0]),
           (None, None), (45, [1.0, 2.0])]
    rows = whitening.whiten(frame(spark, good + bad).repartition(5)).collect()
    check(rows, [v for _, v in good], [i for i, _ in good])
    # repeated rows and ids each count
    twice = whitening.whiten(frame(spark, good + [(3, good[3][1]), (None, good[5][1]), (7, good[8][1])])).collect()
    assert {r.n for r in twice} == {33} and len(twice) == 4 * 33
    assert len([r for r in twice if r.id is None]) == 4 and len([r for r in twice if r.id == 3]) == 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [3.0]), (2, [3.0])], [(1, [1.0] * 4)] * 9])
def test_tables_without_variance(spark, rows):
    assert whitening.whiten(frame(spark, rows)).collect() == []


def test_fewer_directions_than_dimensions(spark):
    """Points on a line have one component."""
    rows = whitening.whiten(frame(spark, [(i, [i * 1.0, i * 2.0, 5.0]) for i in range(10)])).collect()
    assert {r.component for r in rows} == {1} and all(abs(r.explained - 1) < 1e-12 for r in rows)


def test_wide_entries(spark):
    rows = [(i, [c, float(i)]) for i, c in enumerate([1e300, -1e300, 5.0, 1e12, -7.25, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} <= {1, 2} and all(r.identity_error < 1e-4 for r in got)
    near = [(i, [1e9 * i, 1.0 * i * i]) for i in range(50)]
    _, deviation, _, _ = plain([v for _, v in near])
    assert all(r.deviation == deviation[r.id] for r in whitening.whiten(frame(spark, near)).collect())
