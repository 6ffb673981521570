import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import none, odd, odd_labels  # noqa: F401
from conftest import SF01, needs
from spikewatch.llm import quality, toxicity
from spikewatch.llm.features import DIM, Features, bounded, learnable


def held(i, parts, rest):
    return None if i is None else zlib.crc32(str(i).encode()) % parts == rest


@pytest.mark.parametrize("module,parts,rest,cut", [(quality, 5, 0, 0.3), (toxicity, 3, 1, 0.7)])
def test_odd_rows(spark, odd, odd_labels, none, module, parts, rest, cut):
    got = module.classify(odd, odd_labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    for r in got:
        assert r.held_out == held(r.doc_id, parts, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    assert module.classify(none, odd_labels).collect() == []
    blank = spark.createDataFrame([], odd_labels.schema)
    assert len({r.score for r in module.classify(odd, blank).collect()}) == 1
    one = odd_labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))
    assert module.classify(odd, one).count() == odd.count()


@needs(SF01)
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r.quality == 1]
    assert np.mean([r.predicted for r in good]) == 1
    assert np.mean([r.predicted for r in rows if r.quality == 0]) <= 0.25


@needs(SF01)
def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    assert np.mean([t > c for t in toxic for c in clean]) + np.mean([t == c for t in toxic for c in clean]) / 2 > 0.75
    assert np.mean([c >= 0.7 for c in clean]) < 0.02


def test_learning_never_sees_the_held_out_fold(spark, odd, odd_labels):
    """Other labels in the held-out fold leave every score as it is."""
    turned = odd_labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality"))
                                   .otherwise(F.col("quality")))
    key = lambda df: sorted((str(r.doc_id), r.score) for r in df.collect())
    assert key(quality.classify(odd, odd_labels)) == key(quality.classify(odd, turned))


def test_sample_is_bounded(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert 800 < bounded(rows, 1000, 3).count() < 1200 and bounded(rows.limit(10), 1000, 3).count() == 10


def test_conflicting_and_null_labels(spark):
    labels = spark.createDataFrame([(2, 1), (2, 1), (2, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    assert sorted(map(tuple, learnable(labels, "quality", 5, 99).collect())) == [(2, 0), (2, 1)]


def test_features_are_pure():
    a, b = Features(beginnings=(4,)), Features(beginnings=(4,))
    b.of(b"other words first")
    for text in (b"", None, b"One two two TWO!!", b"x\n" * 50):
        assert (a.of(text) == b.of(text)).all() and (np.diff(a.of(text)) > 0).all()


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.r_[rng.integers(100, 5000, 30), 7 if i % 2 else 9]).astype(np.int32) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    ratio = quality.log_count_ratio(rows, y > 0)
    w, b = quality.dual_descent(rows, y, ratio)
    assert (np.sign(quality.margins(rows, ratio, w, b)) == y).all() and len(w) == DIM


def test_unlabelled_positives_do_not_count_as_clean():
    """A tenth of the unlabelled hold the toxic mark; the model still calls it toxic."""
    rng = np.random.default_rng(0)
    mark = lambda toxic: np.unique(np.r_[rng.integers(100, 3000, 25), [7] if toxic else []]).astype(np.int32)
    rows = [mark(True) for _ in range(200)] + [mark(i % 10 == 0) for i in range(1000)]
    import pickle
    w, b = pickle.loads(toxicity.fit(rows, np.r_[np.ones(200), np.zeros(1000)], 0.1))
    score = lambda r: 1 / (1 + np.exp(-(w[r].sum() + b)))
    assert score(mark(True)) > 0.8 and score(mark(False)) < 0.2


def test_keep_good_keeps_columns(odd, odd_labels):
    kept = quality.keep_good(odd, odd_labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_the_prior_comes_from_the_whole_fold(spark, monkeypatch):
    """However few texts the sample of the unlabelled holds, the prior behind the
    scores is that of a plain count over all texts of the learning fold; toxic
    texts, one in 150, are found and clean ones left alone."""
    rng = np.random.default_rng(2)
    clean, bad = [f"w{i}" for i in range(400)], [f"vile{i}" for i in range(8)]
    rows, toxic = [], {}
    for i in range(6000):
        toxic[i] = i % 150 == 0
        own = list(rng.choice(clean, 30)) + (list(rng.choice(bad, 5)) if toxic[i] else [])
        rows.append((i, " ".join(rng.permutation(own))))
    extra = [(10_000 + i, " ".join([*rng.choice(clean, 30), *rng.choice(bad, 5)])) for i in range(60)]
    labels = [(i, int(toxic[i])) for i in range(0, 1500)] + [(i, 1) for i, _ in extra]
    toxic |= {i: True for i, _ in extra}
    kept, real = {}, toxicity.train

    def train(*given, **options):
        kept["model"] = real(*given, **options)
        return kept["model"]

    monkeypatch.setattr(toxicity, "train", train)
    got = toxicity.classify(spark.createDataFrame(rows + extra, "doc_id long, text string"),
                            spark.createDataFrame(labels, "doc_id long, toxic int"), unlabelled=400).collect()
    import pickle
    model, features = pickle.loads(kept["model"]), toxicity.make_features()
    marks, odds, texts = 0, {}, 0
    w, b = pickle.loads(model.linear)
    for i, t in rows + extra:
        own = features.of(t.encode())
        odds[i] = float(w[own].sum() + b)
        if not held(i, 3, 1):
            marks, texts = marks + len(set(own) & set(model.marks)), texts + 1
    prior = marks / texts / model.marks_of_toxic
    real_share = np.mean([toxic[i] for i, _ in rows + extra if not held(i, 3, 1)])
    assert 0 < prior < model.most and prior == pytest.approx(real_share, rel=0.2)
    move = np.log(prior / (1 - prior)) - np.log(model.prior / (1 - model.prior))
    for r in got:
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(odds[r.doc_id] + move, -30, 30))), rel=1e-5, abs=1e-9)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.predicted for r in unseen if toxic[r.doc_id]]) >= 0.9
    assert np.mean([r.predicted for r in unseen if not toxic[r.doc_id]]) <= 0.005
