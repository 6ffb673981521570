"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt into shards of bounded size.  Each shard is a tree of median
splits along the widest side, every node with its tight bounding box and its
smallest id.  A query visits a tree best-first: the largest inner product that
a node's box allows orders the visits and prunes all nodes that cannot beat the
kth best found so far.  Every block of queries starts in one shard, and its kth
scores travel to the visits of all other shards.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikewatch.llm.common import cut

#: Products of integers below this size add up exactly in doubles.
EXACT = float(1 << 53)


def scaled(vector: Column, times: float = 256.0) -> Column:
    """floor(times * x) of every component; NULL for a vector that is NULL or
    holds a component that is NULL, NaN or infinite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * times).cast("long")))


class Tree:
    """KD-tree over the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = 256):
        order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        lows, highs, firsts = [], [], []

        def grow(a: int, b: int) -> int:
            node, rows = len(self.spans), points[order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            self.spans.append((a, b))
            self.kids.append(None)
            lows.append(low)
            highs.append(high)
            firsts.append(int(ids[order[a:b]].min()))
            if b - a > leaf and len(low) and (high > low).any():
                side = int((high - low).argmax())
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, side], mid)]
                self.kids[node] = (grow(a, a + mid), grow(a + mid, b))
            return node

        grow(0, len(ids))
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.first = np.array(lows), np.array(highs), np.array(firsts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with any point of each box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[float, int]]]:
        """Per query its best (score, id) pairs, best first, that are at least
        as good as ``kth``; the query's own row (its id and vector) is left out."""
        wide = max(float(np.abs(queries).max(initial=0)), 1.0) * max(float(np.abs(self.points).max(initial=0)), 1.0)
        exact = wide * max(queries.shape[1], 1) < EXACT
        kind = np.float64 if exact else object  # object: Python's integers
        points, asked = self.points.astype(kind), queries.astype(kind)
        tops = Tree.bounds(_Boxes(self.low.astype(kind), self.high.astype(kind)), asked)
        out = []
        for q in range(len(asked)):
            best: list[tuple] = []  # heap of (score, -id), the worst first
            least = kth[q]
            todo = [(-tops[q, 0], 0)]
            while todo:
                top, node = heapq.heappop(todo)
                worst = best[0] if len(best) == k else None
                if -top < least or (worst and (-top < worst[0])):
                    break
                if worst and -top == worst[0] and self.first[node] > -worst[1]:
                    continue
                if kids := self.kids[node]:
                    for kid in kids:
                        heapq.heappush(todo, (-tops[q, kid], kid))
                    continue
                a, b = self.spans[node]
                scores = points[a:b] @ asked[q]
                bar = max(least, best[0][0]) if len(best) == k else least
                fit = np.flatnonzero(scores >= bar)
                mine = self.ids[a:b][fit] == own[q]
                mine[mine] = (self.points[a:b][fit[mine]] == queries[q]).all(axis=1)
                fit = fit[~mine]
                if len(fit) > k:
                    fit = fit[np.lexsort((self.ids[a:b][fit], -scores[fit]))[:k]]
                for i in fit:
                    entry = (scores[i], -int(self.ids[a + i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return out


class _Boxes:
    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), dim)


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    dim = int(pdf["dim"].iloc[0])
    pdf = pdf.sort_values(["id", "row"])
    tree = Tree(pdf["id"].to_numpy(), _matrix(pdf["vector"], dim))
    return pd.DataFrame({"dim": [dim], "shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})


def _found(k: int):
    def visit(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(trees) and len(queries):
            own = queries["id"].to_numpy()
            kth = queries["kth"].to_numpy(dtype=np.float64)
            asked = _matrix(queries["vector"], int(queries["dim"].iloc[0]))
            found = pickle.loads(trees["tree"].iloc[0]).search(asked, own, k, kth)
            for row, q, hits in zip(queries["row"], own, found):
                rows += [(int(row), int(q), int(i), int(s)) for s, i in hits]
        return pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return visit


def top_k(vectors: DataFrame, queries: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
          times: float = 256.0, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """The ``k`` best rows (all, if fewer) for every row with ``queries`` true:
    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller id.

    Components become floor(times * x).  Vectors that are NULL or hold a NULL
    or non-finite component take no part, nor do rows with a NULL id.  Rows that
    agree in id and components count once; rows of one id with other components
    are rows of their own, as queries (each with its ranks) and as candidates,
    also for one another.  Only vectors of the same length meet.  An empty table
    gives no rows; other columns are not looked at."""
    own = vectors.select(vectors[id_col].cast("long").alias("id"), scaled(vectors[vector_col], times).alias("vector"), queries.alias("asks"))
    own = own.where("id IS NOT NULL AND vector IS NOT NULL").groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    own = cut(own.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))
    rows, asking = own.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    shards, blocks = max(1, -(-rows // shard_rows)), max(1, -(-asking // block_rows))
    draw = F.xxhash64("id", "vector")
    trees = cut(own.withColumn("shard", F.pmod(draw, F.lit(shards))).groupBy("dim", "shard").applyInPandas(
        _built, "dim int, shard long, tree binary"))  # one bounded tree a row
    block = F.pmod(F.shiftrightunsigned(draw, 20), F.lit(blocks))
    asked = own.where("asks").select("dim", "row", "id", "vector", block.alias("block"))
    key = ["dim", "shard", "block"]
    schema = "row long, query_id long, vec_id long, score long"

    def visits(pairs: DataFrame) -> DataFrame:
        """Search each (tree, block of queries) that ``pairs`` of queries name."""
        wanted = pairs.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
        sent = trees.join(wanted, (F.col("dim") == F.col("d")) & (F.col("shard") == F.col("s"))).select("d", "s", "b", "tree")
        return sent.groupBy("d", "s", "b").cogroup(pairs.groupBy(*key)).applyInPandas(_found(k), schema)

    home = F.pmod("block", F.lit(shards))
    first = cut(visits(asked.withColumn("shard", home).withColumn("kth", F.lit(float("-inf")))))
    kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = asked.join(kth, "row", "left") \
        .withColumn("kth", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where(F.col("shard") != home)
    hits = first.union(visits(others.select(*key, "row", "id", "vector", "kth")))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
