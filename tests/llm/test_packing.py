import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import none, odd  # noqa: F401
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spikewatch.llm import packing
from spikewatch.llm.queries import op9_packing


def plain_best_fit(lengths, window):
    bins = [window - window for n in lengths for _ in range(n // window)]
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([8, 16, 32]))
@settings(max_examples=200, deadline=None)
def test_best_fit_and_closing(lengths, window):
    whole = packing.best_fit(lengths, window)
    assert sorted(window - sum(p[2] for p in w) for w in whole) == plain_best_fit(lengths, window)
    done, left = packing.fill_gaps(whole, window)
    assert all(sum(p[2] for p in w) == window for w in done) and sum(p[2] for p in left) < window
    closed = done + packing.in_powers(left)
    seen = sorted(p for w in closed for p in w)
    at = {}
    for d, start, n in seen:
        assert start == at.get(d, 0) and n > 0
        at[d] = start + n
    assert at == {d: n for d, n in enumerate(lengths)}
    sums = [sum(p[2] for p in w) for w in closed]
    assert all(s == window or s & (s - 1) == 0 for s in sums)
    assert sum(s < window for s in sums) <= window.bit_length()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_tokenizer(tokenizer):
    ids, rng = packing.public_bpe()(), random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "'", "<|endoftext|>", "!", " ", "　", "日", "\x1c", "\x85", "\r\n", "x y", "​", "👍"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(5000)] + [" " * 50_000, "ab" * 20_000, "7" * 5000, "\n " * 3000 + "x"]
    for t in texts:
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, texts, tokenizer):
    """``texts``: list of texts; rows of each text's document must rebuild it."""
    want = {}
    for t in texts:
        own = tuple([*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 1])
        want[own] = want.get(own, 0) + 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(o) * n for o, n in want.items())


def test_query(spark, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = op9_packing(spark, SF001).collect()
    check(rows, docs.values(), tokenizer)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for name, parts in by.items():
        ids = np.array([*tokenizer.encode(docs[name], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


@pytest.mark.parametrize("run", [1 << 22, 500])
def test_odd_rows_rebuild(odd, none, tokenizer, run):
    df = packing.pack(odd.coalesce(1), packing.public_bpe(), run_tokens=run)
    rows = df.collect()
    check(rows, [r.text for r in odd.collect()], tokenizer)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in rows)
    blank = [r for r in rows if r.doc_id in (102, 103)]
    assert len(blank) == 2 and all(r.ids == [1] and r.doc_tokens == 1 for r in blank)
    assert packing.pack(none, packing.public_bpe()).collect() == []


def test_small_partitions_share_their_rests(spark, tokenizer):
    """100 partitions take as many sequences as one, up to the last short ones."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    one = packing.pack(docs.coalesce(1), packing.public_bpe(), with_ids=False)
    many = packing.pack(docs.repartition(100, "doc_id"), packing.public_bpe()).collect()
    check(many, texts, tokenizer)
    for r in many:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    own, ids = {}, {}
    for r in sorted(many, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(r.ids)
        own[r.doc_id] = r.doc_tokens
    assert all(len(ids[d]) == n for d, n in own.items())
    lengths = {}
    for r in many:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert sum(n < 2048 for n in lengths.values()) <= 11
    assert len(lengths) <= 1.05 * one.select("sequence_id").distinct().count()
    few = packing.pack(docs.repartition(100, "doc_id"), packing.public_bpe(), gather=7, run_tokens=1500).collect()
    check(few, texts, tokenizer)


def test_a_tokenizer_file_may_be_given(spark, tokenizer):
    one = spark.createDataFrame([(1, "some text <|endoftext|>")], "doc_id long, text string")
    rows = packing.pack(one, packing.public_bpe(public_tokenizers.path("byte_bpe_50k.json"))).collect()
    ids = [i for r in sorted(rows, key=lambda r: r.start) for i in r.ids]
    assert ids == [*tokenizer.encode("some text <|endoftext|>", add_special_tokens=False).ids, 1]
