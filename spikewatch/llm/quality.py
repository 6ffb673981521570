"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by their class log-count ratio, rows are brought
to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent.  Margins of rows left out in turn calibrate a probability.

The model is learned from a bounded, hash-chosen sample of labelled documents
(``sample_rows``); every whole text is scored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.common import fold
from spikewatch.llm.features import DIM, Features, bounded, fit_in_one_task, learnable, sampled_texts, stacked


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of (share of a feature among good rows' features / among the others')."""
    cols, at = stacked(rows)
    p = smooth + np.bincount(cols[good[at]], minlength=DIM)
    q = smooth + np.bincount(cols[~good[at]], minlength=DIM)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12,
                 seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model on ``ratio``-scaled unit rows
    (bias as one more constant column)."""
    rng = np.random.default_rng(seed)
    values = [ratio[r] for r in rows]
    values = [v / max(np.sqrt(v @ v), 1e-9) for v in values]
    squared = np.array([float(v @ v) + 1 for v in values])
    w, b, dual = np.zeros(DIM), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1
            new = min(max(dual[i] - slope / squared[i], 0.0), cost)
            if step := (new - dual[i]) * y[i]:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(step))
            dual[i] = new
        if moved < 1e-4:
            break
    return w, b


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    out = np.empty(len(rows))
    for i, r in enumerate(rows):
        v = ratio[r]
        out[i] = float(w[r] @ v) / max(np.sqrt(v @ v), 1e-9) + b
    return out


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of P(1 | margin), by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def fit(rows: list[np.ndarray], label: np.ndarray, folds: int = 4) -> bytes:
    """The pickled model; a constant if only one class is present."""
    good = label == 1
    if good.all() or not good.any():
        return pickle.dumps(float((good.sum() + 1) / (len(good) + 2)))
    y = np.where(good, 1.0, -1.0)
    part = np.random.default_rng(3).permutation(len(rows)) % folds
    left_out = np.zeros(len(rows))
    for k in range(folds):
        mine, other = np.flatnonzero(part != k), np.flatnonzero(part == k)
        own = [rows[i] for i in mine]
        if good[mine].all() or not good[mine].any():
            continue
        ratio = log_count_ratio(own, good[mine])
        left_out[other] = margins([rows[i] for i in other], ratio, *dual_descent(own, y[mine], ratio))
    ratio = log_count_ratio(rows, good)
    w, b = dual_descent(rows, y, ratio)
    return pickle.dumps((ratio.astype(np.float32), w.astype(np.float32), b, *calibrate(left_out, y)))


def make_features() -> Features:
    return Features(pairs=True, beginnings=(), shapes=True, repeats=True)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", parts: int = 5, kept_out: int = 0,
          sample_rows: int = 8000, seed: int = 11) -> bytes:
    """Fit on about ``sample_rows`` labelled documents outside the held-out
    fold.  Without any such document the model is the constant 0.5."""
    texts = sampled_texts(docs, bounded(learnable(labels, target, parts, kept_out), sample_rows, seed))
    return fit_in_one_task(texts, make_features, fit) or pickle.dumps(0.5)


def score(docs: DataFrame, model: bytes, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 as column ``name``.  NULL and
    empty texts are scored by the model's bias and repetition marks.  The model,
    whose size the hash space fixes, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        known = pickle.loads(shared.value)
        if isinstance(known, float):
            return pd.Series(np.full(len(texts), known))
        ratio, w, b, a, c = known
        features = make_features()
        m = margins([features.of(t) for t in texts], ratio, w, b)
        return pd.Series(1 / (1 + np.exp(-np.clip(a * m + c, -30, 30))))

    return docs.withColumn(name, of(docs[text_col].cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out`` (NULL for a NULL
    id), ``score`` and ``predicted`` (1 from ``threshold`` up).  Repeated rows
    are scored alike; an empty table gives no rows; columns of ``docs`` other
    than the id and the text are not looked at."""
    parts, kept_out = options.get("parts", 5), options.get("kept_out", 0)
    own = docs.select(docs["doc_id"], docs["text"])
    scored = score(own, train(docs, labels, **options))
    return scored.select("doc_id", (fold("doc_id", parts) == kept_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, columns as given, that score at least ``threshold``."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    return score(packed, train(docs, labels, **options)).where(F.col("score") >= threshold).select("doc.*")
