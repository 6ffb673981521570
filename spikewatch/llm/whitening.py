"""Whitening of vectors from exact bit-sliced cross-products.

Entries become whole numbers.  A block of rows is shifted by each dimension's
least value and cut into bit planes, each packed across the rows into 64-bit
words; the ones that two planes share, counted by AND and popcount and weighted
by the planes' places, add up to the block's cross-products without a rounding.
The totals stay whole numbers through centring; only the finished covariance is
divided and goes to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows packed at a time; a block's words stay small however many rows there are.
BLOCK = 4096
#: Whole numbers leave the tasks as limbs of so many bits, the last one signed.
LIMB, LIMBS = 40, 5
#: Scaled entries are clipped to this size on either side.
WIDEST = 1 << 62


def usable(vector: Column) -> Column:
    """Not NULL and without NULL, NaN or infinite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def whole(vectors: pd.Series, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of every entry, rows by dimensions."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * np.stack(vectors.to_numpy()).astype(np.float64))
    return np.clip(scaled, -WIDEST, WIDEST).astype(np.int64) + shift


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Bit planes (plane, dimension, word) of rows of unsigned numbers, bit i of a
    word being row i's; missing rows count as zero."""
    rows, dims = y.shape
    bits = int(y.max()).bit_length() if y.size else 0
    words = -(-rows // 64)
    planes = np.zeros((bits, dims, words * 8), np.uint8)
    for b in range(bits):
        ones = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        planes[b, :, :-(-rows // 8)] = np.packbits(ones, axis=1, bitorder="little")
    return planes.view(np.uint64)


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact y' y of rows of unsigned numbers, as Python integers."""
    planes = bit_planes(y)
    bits, dims = planes.shape[:2]
    by_place = np.zeros((max(2 * bits - 1, 1), dims, dims), np.int64)
    for a in range(bits):
        for b in range(a, bits):
            ones = np.bitwise_count(planes[a][:, None, :] & planes[b][None, :, :]).sum(axis=2, dtype=np.int64)
            by_place[a + b] += ones if a == b else ones + ones.T
    out = np.zeros((dims, dims), object)
    for place, ones in enumerate(by_place):
        if ones.any():
            out += ones.astype(object) << place
    return out


class Scatter:
    """Row count, sums and cross-products of whole-number rows, exact."""

    def __init__(self, dims: int):
        self.n, self.s, self.p = 0, np.zeros(dims, object), np.zeros((dims, dims), object)

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so exact
        m, k = low.astype(object), len(x)
        sums = (y >> np.uint64(32)).sum(axis=0).astype(object) * (1 << 32) + (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object)
        cross = np.outer(m, sums)
        self.p += cross_products(y) + cross + cross.T + k * np.outer(m, m)
        self.s += sums + k * m
        self.n += k


def _limbs(v: int) -> list[int]:
    return [(v >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [v >> (LIMB * (LIMBS - 1))]


def scatter(vectors: DataFrame, dims: int, scale: float, shift: int) -> Scatter:
    """The scatter of a column ``vector``: tasks send one row per pair of
    dimensions, whatever the number of vectors, and Spark adds them up."""

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Scatter(dims)
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                total.add(whole(pdf["vector"][at:at + BLOCK], scale, shift))
        if total.n:
            rows = [(i, j, *_limbs(int(total.p[i, j]))) for i in range(dims) for j in range(i, dims)]
            rows += [(-1, j, *_limbs(int(total.s[j]))) for j in range(dims)] + [(-1, -1, *_limbs(total.n))]
            yield pd.DataFrame(rows, columns=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    sums = vectors.select("vector").mapInPandas(tasks, schema).groupBy("i", "j").agg(
        *[F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)])
    out = Scatter(dims)
    for r in sums.collect():  # dims * (dims + 3) / 2 + 1 rows
        v = sum(int(r[f"l{k}"]) << (LIMB * k) for k in range(LIMBS))
        if r["j"] < 0:
            out.n = v
        elif r["i"] < 0:
            out.s[r["j"]] = v
        else:
            out.p[r["i"], r["j"]] = out.p[r["j"], r["i"]] = v
    return out


def principal(total: Scatter, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors (columns) and trace of the
    covariance; at most ``components``, and none without variance."""
    n = total.n
    c = n * total.p - np.outer(total.s, total.s)
    cov = np.array([[v / (n * n) for v in row] for row in c], np.float64)  # each entry rounded once
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    keep = int((e[:components] > max(e[0], 0.0) * 1e-11).sum()) if len(e) else 0
    trace = sum(c[i, i] for i in range(len(c))) / (n * n)
    return e[:keep], v[:, :keep], trace


def whiten(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """One row per vector and principal component of x = floor(``scale`` * c) +
    ``shift``: ``id``, ``component`` (from 1), ``n`` (vectors in the fit),
    ``deviation`` (decimal: sum over dimensions of (n*x - S)^2), ``whitened``,
    ``explained`` and ``identity_error`` (the largest absolute entry of the
    whitened rows' own covariance minus the identity).  All are fitted on, and
    returned for, every usable vector.

    Vectors that are NULL, empty or hold NULL or non-finite entries are left
    out, as are those of another length than the commonest (of equally common
    ones, the longest).  Repeated rows and rows with the same or a NULL id each
    count.  Scaled entries are clipped to +-2^62.  Components without variance
    are not returned (a constant or one-row table gives no rows; nor does an
    empty one); equal eigenvalues may take any basis.  A deviation of more than
    38 digits is NULL.  Names of extra columns do not matter."""
    rows = table.select(table[id_col].alias("id"), table[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & (F.size("vector") > 0))
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
    found = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    session = table.sparkSession
    empty = session.createDataFrame([], schema + ", identity_error double")
    if found is None:
        return empty
    dims = found["dims"]
    rows = rows.where(F.size("vector") == dims)
    total = scatter(rows, dims, scale, shift)
    n, s = total.n, total.s
    e, v, trace = principal(total, components)
    if not len(e):
        return empty
    # n * x - S from a shift near the mean, so that it fits a long where it can
    near = np.array([int(t) // n for t in s], np.int64)
    rest = [int(t) - n * int(m) for t, m in zip(s, near)]
    axes = v / np.sqrt(e)
    explained = e / trace

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf[at:at + BLOCK]
                x = whole(part["vector"], scale, shift)
                apart = max(int(x[:, j].max()) - int(near[j]) for j in range(dims)), max(int(near[j]) - int(x[:, j].min()) for j in range(dims))
                widest = n * (max(*apart, 0) + 1)
                if dims * widest * widest < 1 << 62:
                    d = (x - near) * np.int64(n) - np.array(rest, np.int64)
                    deviation, centred = (d * d).sum(axis=1), d / float(n)
                else:
                    d = (x.astype(object) - near.astype(object)) * n - np.array(rest, object)
                    deviation, centred = (d * d).sum(axis=1), (d / n).astype(np.float64)
                w = centred @ axes
                k = w.shape[1]
                yield pd.DataFrame({
                    "id": part["id"].astype("Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)),
                    "n": np.int64(n), "deviation": [str(t) for t in deviation for _ in range(k)], "whitened": w.ravel(),
                    "explained": np.tile(explained, len(part))})

    text = schema.replace("decimal(38,0)", "string")
    out = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInPandas(tasks, text) \
        .withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = np.zeros(len(e)), np.zeros((len(e), len(e)))
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                x = whole(pdf["vector"][at:at + BLOCK], scale, shift)
                w = ((x - near).astype(np.float64) - np.array([r / n for r in rest])) @ axes
                one += w.sum(axis=0)
                two += w.T @ w
        yield pd.DataFrame([(-1, j, t) for j, t in enumerate(one)] + [(i, j, two[i, j]) for i in range(len(e)) for j in range(len(e))],
                           columns=["i", "j", "t"])

    got = {(r["i"], r["j"]): r["t"] / n for r in rows.select("vector").mapInPandas(moments, "i int, j int, t double")
           .groupBy("i", "j").agg(F.sum("t").alias("t")).collect()}  # components * (components + 1) rows
    error = max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(len(e)) for j in range(len(e)))
    return out.withColumn("identity_error", F.lit(float(error)))
