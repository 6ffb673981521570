"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive set; the unlabelled set is a sample
of texts whose labels are not looked at.  A linear model on n-gram indicators
is trained with numpy on the risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-)),

whose second term estimates the risk on clean text.  Where it turns negative
(the model fits the positives hidden among the unlabelled), the step goes the
other way, as in non-negative PU learning.  ``prior`` is the share of toxic
rows among the labelled ones of the learning fold, or less where the clearest
features show that toxic text is rarer among the unlabelled.

Both sets are bounded, hash-chosen samples.  Every whole text is scored, and the
clearest features are counted in all texts of the learning fold on the way: the
prior that they show there replaces the sample's by a shift of all log-odds.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.common import cut, fold, hash_below, sample_share
from spikewatch.llm.features import DIM, Features, bounded, fit_in_one_task, learnable, sampled_texts, stacked


def make_features() -> Features:
    return Features(pairs=False, beginnings=(4, 5), shapes=False, repeats=False)


#: How many of the clearest features measure the prior.
CLEAREST = 10


def _evidence(rows: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By column: counts among positives and unlabelled, the positives' count if
    they were like the unlabelled, and minus the log of a bound of the chance
    that it is as high as it is (Chernoff bound of the Poisson tail)."""
    cols, at = stacked(rows)
    p = np.bincount(cols[positive[at]], minlength=DIM)
    u = np.bincount(cols[~positive[at]], minlength=DIM)
    expected = positive.sum() * (u + 1) / ((~positive).sum() + 1)
    return p, u, expected, np.where(p > expected, p * np.log(np.maximum(p, 1) / expected) - p + expected, 0.0)


def telling(rows: list[np.ndarray], positive: np.ndarray, evidence: float = 7.0, lift: float = 2.0) -> np.ndarray:
    """Columns at least ``lift`` times as frequent among positives as among the
    unlabelled, by so much that chance explains it with a probability of at
    most exp(-``evidence``)."""
    p, _, expected, told = _evidence(rows, positive)
    return np.flatnonzero((told >= evidence) & (p >= lift * expected)).astype(np.int32)


def clearest(rows: list[np.ndarray], positive: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The columns with most evidence, and how many of them a positive and an
    unlabelled text has on average: their ratio is the toxic share of the
    unlabelled, if clean text hardly has them."""
    p, u, _, told = _evidence(rows, positive)
    best = np.sort(np.argsort(-told, kind="stable")[:CLEAREST])
    return best, float(p[best].sum() / positive.sum()), float(u[best].sum() / (~positive).sum())


def nn_pu(cols: np.ndarray, at: np.ndarray, n: int, width: int, positive: np.ndarray, prior: float, *,
          rounds: int = 600, rate: float = 0.05, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample with the logistic loss."""
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    np_, nu = positive.sum(), (~positive).sum()
    for t in range(1, rounds + 1):
        g = np.bincount(at, w[cols], minlength=n) + b
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss_neg = np.logaddexp(0, g)
        clean = loss_neg[~positive].mean() - prior * loss_neg[positive].mean()
        # gradients of the losses by the margin: (p - 1) as positive, p as negative
        rest = np.where(positive, -prior * p / np_, p / nu)
        d = np.where(positive, prior * (p - 1) / np_, 0.0) + rest if clean >= 0 else -rest
        grad = np.append(np.bincount(cols, d[at], minlength=width) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, prior: float) -> bytes:
    """``label`` 1: confirmed toxic, 0: unlabelled, of which the share ``prior``
    is toxic.  The pickled weights and bias."""
    positive = label == 1
    chosen = telling(rows, positive)
    place = np.full(DIM, -1)
    place[chosen] = np.arange(len(chosen))
    cols, at = stacked(rows)
    inside = place[cols] >= 0
    w, b = nn_pu(place[cols[inside]], at[inside], len(rows), len(chosen), positive, prior)
    weights = np.zeros(DIM, np.float32)
    weights[chosen] = w
    return pickle.dumps((weights, b))


@dataclass
class Model:
    #: Pickled weights and bias; None where there was nothing to tell apart.
    linear: bytes | None
    #: The prior that the linear model was fitted with, and the most it may be.
    prior: float
    most: float
    #: The clearest columns, and how many of them a toxic text has on average.
    marks: np.ndarray
    marks_of_toxic: float

    def shift(self, marks: int, texts: int) -> float:
        """What turns the log-odds to the prior that ``marks`` clearest features
        in ``texts`` texts show."""
        if not texts or self.marks_of_toxic <= 0:
            return 0.0
        prior = min(self.most, max(marks / texts / self.marks_of_toxic, 0.5 / (texts + 1)))
        return float(np.log(prior / (1 - prior)) - np.log(self.prior / (1 - self.prior)))


def fitted(rows: list[np.ndarray], label: np.ndarray, most: float) -> Model:
    positive = label == 1
    if positive.all() or not positive.any():
        return Model(None, most, most, np.zeros(0, np.int64), 0.0)
    marks, of_toxic, of_others = clearest(rows, positive)
    prior = min(most, max(of_others / of_toxic, 0.001)) if of_toxic else most
    return Model(fit(rows, label, prior), prior, most, marks, of_toxic)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", parts: int = 3, kept_out: int = 1,
          positives: int = 4000, unlabelled: int = 12000, seed: int = 23) -> bytes:
    """Fit on about ``positives`` toxic documents and ``unlabelled`` documents of
    the learning fold.  The pickled ``Model``, without toxic documents a constant."""
    known = learnable(labels, target, parts, kept_out)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic = bounded(known.where("label = 1"), positives, seed)
    prior = min(max((counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1), 0.001), 0.5)
    pool = docs.where(docs["doc_id"].isNotNull() & (fold("doc_id", parts) != kept_out)).select("doc_id")
    share = sample_share(pool.count(), unlabelled)
    others = pool.where(hash_below(share, "doc_id", seed=seed + 1)).distinct().withColumn("label", F.lit(0))
    texts = sampled_texts(docs, toxic.union(others))
    model = fit_in_one_task(texts, make_features, lambda rows, label: pickle.dumps(fitted(rows, label, prior)))
    return model or pickle.dumps(Model(None, prior, prior, np.zeros(0, np.int64), 0.0))


def log_odds(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``odds``, the log-odds of being toxic by the model's own
    prior, and ``marks``, how many of its clearest features the text has.  NULL
    and empty texts have the bias.  The broadcast model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("odds double, marks long")
    def of(texts: pd.Series) -> pd.DataFrame:
        known = pickle.loads(shared.value)
        if known.linear is None:
            return pd.DataFrame({"odds": np.full(len(texts), np.log(known.prior / (1 - known.prior))), "marks": np.zeros(len(texts), np.int64)})
        w, b = pickle.loads(known.linear)
        features, found = make_features(), np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            own = features.of(t)
            at = np.searchsorted(own, known.marks)
            found[i] = w[own].sum() + b, (own[np.minimum(at, len(own) - 1)] == known.marks).sum() if len(own) else 0
        return pd.DataFrame({"odds": found[:, 0], "marks": found[:, 1].astype(np.int64)})

    return docs.withColumn("of", of(docs[text_col].cast("binary"))).select(*docs.columns, "of.odds", "of.marks")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out`` (NULL for a NULL
    id), ``score`` and ``predicted`` (1 from ``threshold`` up).  Repeated rows
    are scored alike; an empty table gives no rows; other columns of ``docs``
    are not looked at.  The log-odds, a row of numbers a document, are kept in
    the checkpoint folder until the whole learning fold has shown its prior."""
    parts, kept_out = options.get("parts", 3), options.get("kept_out", 1)
    own = docs.select(docs["doc_id"], docs["text"])
    model = train(docs, labels, **options)
    held = fold("doc_id", parts) == kept_out
    rows = cut(log_odds(own, model).select("doc_id", held.alias("held_out"), "odds", "marks"))
    seen = rows.where(~F.col("held_out")).agg(F.coalesce(F.sum("marks"), F.lit(0)), F.count("*")).first()
    odds = F.least(F.greatest(F.col("odds") + pickle.loads(model).shift(*seen), F.lit(-30.0)), F.lit(30.0))
    scored = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-odds))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
