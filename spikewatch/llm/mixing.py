"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words.  Every source gets a budget; whole
repeats of the source are taken while they fit, and the rest of the budget is
fitted with a subset of its documents: the documents are counted by exact size,
every size gives its share, and bounded-knapsack dynamic programming over the
left-over counts closes the remaining gap.  Only counts by size are gathered
for that.  Which documents of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gaps above this many words are first narrowed by whole documents.
EXACT = 1 << 17
#: A group of documents of one source and size above this is ranked in parts.
PART_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: np.ndarray, weights: np.ndarray, times: float = 3.0) -> np.ndarray:
    """Budgets in proportion to ``weights`` that add up to all sizes, none above
    ``times`` its source's size; what is cut off goes to the others by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    cap, target, free = times * sizes, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > cap)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = cap[over]
        left -= cap[over].sum()
        free &= ~over
    return target


def subset_sum(gap: int, sizes: list[int], spare: list[int]) -> list[int]:
    """How many documents of each size to take, at most ``spare``, for the sum
    nearest to ``gap`` (the smaller one of two): reachable sums are the bits of
    an integer, and each size enters in powers of two."""
    taken = [0] * len(sizes)
    if gap <= 0:
        return taken
    mask = (1 << (2 * gap + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach = 1
    for i, (size, n) in enumerate(zip(sizes, spare)):
        n, k = min(n, 2 * gap // size), 1
        while n and not reach >> gap & 1:
            k = min(k, n)
            steps.append((i, k, reach))
            reach |= reach << (size * k) & mask
            n, k = n - k, 2 * k
        if reach >> gap & 1:
            break
    low = (reach & ((1 << (gap + 1)) - 1)).bit_length() - 1
    above = reach >> gap
    high = gap + (above & -above).bit_length() - 1 if above else None
    at = high if high is not None and high - gap < gap - low else low
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= sizes[i] * k
    return taken


def fit_budget(target: float, sizes: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(whole repeats, documents of each size taken once more) of a source with
    ``counts`` documents of each of the distinct positive ``sizes``."""
    total = int((sizes * counts).sum())
    budget = int(round(target))
    repeats = budget // total if total else 0
    rest = budget - repeats * total
    more = np.array([int(c) * rest // total for c in counts], np.int64) if total else np.zeros(len(counts), np.int64)
    gap = rest - int((more * sizes).sum())
    spare = counts - more
    for i in np.argsort(-sizes):  # narrow a wide gap by whole documents
        if gap <= EXACT:
            break
        n = min(int(spare[i]), (gap - EXACT // 2) // int(sizes[i])) if gap > EXACT // 2 else 0
        if n > 0:
            more[i], spare[i], gap = more[i] + n, spare[i] - n, gap - n * int(sizes[i])
    order = [int(i) for i in np.argsort(-sizes) if spare[i] > 0 and sizes[i] <= 2 * gap]
    for i, n in zip(order, subset_sum(gap, [int(sizes[i]) for i in order], [int(spare[i]) for i in order])):
        more[i] += n
    return int(repeats), more


def plan(counts: DataFrame, times: float, cycle: tuple[int, ...]) -> DataFrame:
    """From counts by (``no_source``, ``source``, ``size``): per source and size
    ``docs``, ``source_size``, ``target``, ``repeats`` and ``more``.  One row per
    source meets in one task for the targets, one row per size of a source for
    the fit."""
    totals = counts.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["bytes"] = pdf["source"].str.encode("utf-8")
        pdf = pdf.sort_values(["no_source", "bytes"]).drop(columns="bytes")
        weights = np.array(cycle)[np.arange(len(pdf)) % len(cycle)]
        pdf["target"] = shared_targets(pdf["source_size"].to_numpy(), weights, times)
        return pdf

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        some = (pdf["size"] > 0).to_numpy()
        repeats, more = fit_budget(float(pdf["target"].iloc[0]), pdf["size"].to_numpy()[some], pdf["docs"].to_numpy()[some])
        pdf["repeats"], pdf["more"] = np.where(some, repeats, 1), 0  # wordless documents are taken once
        pdf.loc[some, "more"] = more
        return pdf

    key = "no_source boolean, source string"
    aims = totals.groupBy().applyInPandas(targets, f"{key}, source_size long, target double")
    sized = counts.join(aims, ["no_source", "source"])
    return sized.groupBy("no_source", "source").applyInPandas(
        fit, f"{key}, size long, docs long, source_size long, target double, repeats long, more long")


def mix(docs: DataFrame, carry: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        times: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (a struct of the ``carry`` columns,
    all by default), ``size``, ``source_size``, ``target`` and ``copies``, how
    often the mix takes it (at most ``times``, rounded up).

    Sources weigh ``cycle`` in code point order, NULL last as a source of its
    own.  A NULL or wordless text has size 0 and is taken once.  Repeated rows
    are documents of their own.  An empty table gives no rows."""
    keep = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs[source_col].isNull().alias("no_source"),
                       F.coalesce(docs[source_col], F.lit("")).alias("source"), word_count(docs[text_col]).alias("size"),
                       F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]).alias("draw"))
    key = ["no_source", "source", "size"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("docs"))
    fitted = plan(counts, times, cycle)
    parts = F.ceil(F.col("docs") / PART_ROWS)
    # the draw's upper bits choose a part, so parts are in order of the draw
    part = F.floor((F.shiftrightunsigned("draw", 33) * parts) / F.lit(float(1 << 31))).cast("long")
    open_rows = rows.join(fitted, key).withColumn("part", part)
    sizes = rows.select(*key, "draw").join(fitted.where(F.col("docs") > PART_ROWS).select(*key, "docs"), key) \
        .withColumn("part", part).groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    order = F.expr("draw ^ (-9223372036854775807L - 1)")  # the draw as an unsigned number
    rank = F.row_number().over(Window.partitionBy(*key, "part").orderBy(order))
    ranked = open_rows.withColumn("rank", rank).join(before, [*key, "part"], "left")
    extra = (F.col("rank") + F.coalesce("before", F.lit(0)) <= F.col("more")).cast("long")
    return ranked.select("doc", "size", "source_size", "target", (F.col("repeats") + extra).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, columns as in ``docs``, each as often as it is taken."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
