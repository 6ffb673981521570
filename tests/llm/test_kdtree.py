import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikewatch.llm import kdtree


def plain(rows, k=5, every=50):
    usable = set()
    for name, v in rows:
        if name is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.add((name, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for q, a in usable:
        if q % every == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if (i, b) != (q, a) and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, id string, dim int, shard int")
    got = kdtree.top_k(df, F.col("vec_id") % 50 == 0, **options)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 4096), (60, 3)])
def test_matches_brute_force_with_ties(spark, shard_rows, block_rows):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # a common vector
    assert search(spark, rows, shard_rows=shard_rows, block_rows=block_rows) == plain(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [None, 1.0]),
            (2, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [1.0]), (200, []), (4, []), (250, [5.0]), (5, [-0.001, 0.0])]
    assert search(spark, rows) == plain(rows)
    assert search(spark, [(0, [1.0])]) == [] and search(spark, []) == []


def test_rows_of_one_id_stay_apart(spark):
    rows = [(1, [3.0]), (1, [2.0]), (50, [1.0]), (50, [1.0]), (50, [4.0])]
    assert search(spark, rows) == [  # queries [1.0] and [4.0]
        (50, 1, 1, 786432), (50, 1, 50, 262144), (50, 2, 1, 196608), (50, 2, 1, 524288), (50, 3, 1, 131072), (50, 3, 50, 262144)]
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.choice([1, 2, 50, 100, 100, 100, 100], 400), np.round(rng.normal(size=(400, 3)), 1))]
    assert search(spark, rows, shard_rows=60, block_rows=20) == plain(rows)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(np.float32(3e6 + i * 1000)), float(np.float32(-2e6 + 7 * i))]) for i in range(101)]
    assert search(spark, rows, shard_rows=30) == plain(rows)


def test_tree_prunes():
    """Far fewer rows than all are scored where clusters lie apart."""
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(40, 1, 3)) * 1000 + rng.normal(size=(40, 200, 3))).reshape(-1, 3).astype(np.int64)
    tree = kdtree.Tree(np.arange(len(points)), points, leaf=64)
    q = points[5:6]
    top = tree.search(q, np.array([5]), 3, np.array([-np.inf]))[0]
    scores = points @ q[0]
    scores[5] = -10 ** 15
    assert [int(i) for _, i in top] == list(np.lexsort((np.arange(len(points)), -scores))[:3])
    bounds = tree.bounds(q)[0]
    leaves = [n for n, kids in enumerate(tree.kids) if kids is None]
    assert sum(bounds[n] >= top[-1][0] for n in leaves) < len(leaves) / 3
    for n in leaves:
        a, b = tree.spans[n]
        assert (tree.points[a:b] @ q[0]).max() <= bounds[n]
