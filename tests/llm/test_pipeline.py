import re

import corpus_pipeline
from cases import none, odd, same_rows  # noqa: F401
from conftest import SF001

import __spark_entry__ as E
from spikewatch.llm import mixing, pii, quality, simhash_dedup


def test_stages_by_hand(spark, tmp_path):
    """Each stage on what the one before wrote, checked against its operator's rules."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    steps = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF001).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        steps.append((name, docs, after))
        if name != "packing":
            assert after.columns == docs.columns
        docs = after
    (_, raw, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, packed) = steps
    scores = {r.doc_id: r.predicted for r in quality.classify(raw, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p == 1}
    marked = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert marked <= {r.doc_id for r in good.collect()}
    groups = simhash_dedup.near_duplicates(good).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component for r in groups})
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text) and not re.search(r"@[a-z0-9]+\.", r.text)
        assert r.text == before[r.doc_id] or "[" in r.text
    copies = {r.doc.doc_id: r.copies for r in mixing.mix(clean).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {i: n for i, n in copies.items() if n}
    ends = sum(1 for r in packed.collect() if r.start + r.length == r.doc_tokens)
    assert ends == mixed.count()


def test_odd_rows_pass_every_stage(spark, odd, none, tmp_path):
    for start, label in ((odd, "odd"), (none, "none")):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF001).write.parquet(str(tmp_path / f"{label}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{label}{k}"))
            assert name == "packing" or docs.columns == odd.columns
        assert (docs.count() > 0) == (label == "odd")


def test_run_is_registered(spark):
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SF001).count() > 0


def test_stages_change_nothing_they_should_keep(spark, odd):
    assert same_rows(pii.redact(odd.where("doc_id BETWEEN 0 AND 23")), odd.where("doc_id BETWEEN 0 AND 23"))
