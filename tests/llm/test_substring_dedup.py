import random

import numpy as np
import pytest
from cases import frame, none, odd  # noqa: F401
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st

from spikewatch.llm import substring_dedup as dedup
from spikewatch.llm.queries import op12_substring_dedup


def plain(rows, length=50):
    """(id, bytes, spans, kept) of each (id, text)."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for p in range(len(b) - length + 1) if i is not None else ():
            first[b[p:p + length]] = min(first.get(b[p:p + length], i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p:p + length]] < i:
                gone[p:p + length] = True
        turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).tolist()
        out.append((i, len(b), tuple(zip(turn[::2], turn[1::2])), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((r.id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept))
                   for r in dedup.remove_repeats(df, **options).collect()), key=str)


def test_first_words_of_every_place():
    data = np.frombuffer(bytes(range(1, 30)), np.uint8)
    for n in range(30):
        want = [int.from_bytes((bytes(data[i:min(i + 8, n)]) + b"\0" * 8)[:8], "big") for i in range(n)]
        assert dedup.words8(data[:n]).tolist() == want


@given(st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_buckets_are_equal_strings(rng):
    letters = rng.choice([b"a", b"ab", b"abcdef"])
    unit = bytes(rng.choices(letters, k=60))
    strings = [bytes(rng.choices(letters, k=rng.randint(50, 90))) if rng.random() < 0.4 else unit[rng.randint(0, 9):] + unit[:rng.randint(0, 30)]
               for _ in range(rng.randint(1, 12))]
    owner = np.array([rng.randint(0, 3) for _ in strings])
    ends = np.cumsum([len(s) for s in strings])
    pointer = dedup.bucket_pointers(np.frombuffer(b"".join(strings), np.uint8), ends, owner, 50)
    groups = {}
    for s, e, o in zip(strings, ends.tolist(), owner.tolist()):
        for i in range(len(s) - 49):
            groups.setdefault(s[i:i + 50], []).append((e - len(s) + i, o))
    names = {}
    for text, members in groups.items():
        if len({o for _, o in members}) > 1:  # of several documents: one bucket, and no other string's
            mine = {int(pointer[p]) for p, _ in members}
            assert len(mine) == 1 and mine != {-1} and names.setdefault(mine.pop(), text) == text


def test_stretches_cover_every_window_once():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcdefgh ", k=n)) for n in (0, 49, 50, 51, 700, 3000)]
    for block in (64, 1 << 18):
        before, dedup.BLOCK = dedup.BLOCK, block
        try:
            cut = dedup.Stretches(texts, 50)
        finally:
            dedup.BLOCK = before
        seen = [(r, s + k) for r, s, n in zip(cut.row.tolist(), cut.start.tolist(), cut.windows.tolist()) for k in range(n)]
        assert sorted(seen) == [(r, p) for r, t in enumerate(texts) for p in range(len(t) - 49)]


@pytest.mark.parametrize("options", [{}, {"part_bytes": 1 << 14, "bucket_bytes": 1 << 14}, {"part_bytes": 1 << 15, "crowd": 1}, {"length": 64}])
def test_documents(spark, options):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], options.get("length", 50))
    assert found(docs, **options) == want and any(s for _, _, s, _ in want)


def test_query(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in plain([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: tuple(r)[1:] for r in op12_substring_dedup(spark, SF001).collect()} == want


@pytest.mark.parametrize("options", [{}, {"part_bytes": 5000, "bucket_bytes": 5000, "crowd": 2}])
def test_odd_rows(odd, none, options):
    assert found(odd, **options) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none, **options) == []


def test_copies_near_copies_and_passages(spark):
    """A passage in every document, copies of one text under many ids, texts one
    byte apart, a repeat within one text, and rows that share an id."""
    rng = random.Random(6)

    def text(n):
        return "".join(rng.choices("abcdefghij \né", k=n))

    passage, whole = text(120), text(400)
    rows = [(i, text(rng.randint(0, 80)) + passage + text(rng.randint(0, 80))) for i in range(60)]
    rows += [(i, whole) for i in range(100, 140)] + [(i, whole[:i] + "#" + whole[i + 1:]) for i in range(150, 190)]
    twice = text(60)
    rows += [(200, twice + text(5) + twice), (201, twice), (201, text(70) + twice), (201, twice), (-9, passage[:70]), (None, passage), (300, "")]
    docs = frame(spark, [(i, t, None, None) for i, t in rows]).repartition(6)
    want = plain(rows)
    for options in ({}, {"part_bytes": 2000, "bucket_bytes": 2000, "crowd": 5}):
        assert found(docs, **options) == want
    by = {i: k for i, _, _, k in want}
    assert by[139] == b"" and by[200] == (rows[-7][1]).encode()  # the copies go, a text's own repeat stays


def test_short_lengths_are_refused(odd):
    with pytest.raises(ValueError):
        dedup.remove_repeats(odd, length=20)
