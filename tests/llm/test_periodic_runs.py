import hashlib
import random
import zlib

import numpy as np
from cases import none, odd  # noqa: F401
from conftest import SF01
from hypothesis import given, settings
from hypothesis import strategies as st

from spikewatch.llm import periodic_runs as runs
from spikewatch.llm.queries import op13_periodic_runs, planted_loop


def plain(words, least=12):
    """Every maximal stretch equal to itself at every lag; the smallest lag of a stretch is its period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= max(q, least - q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in out.items())


def repetitive(rng):
    n, v = rng.randint(0, 350), rng.choice([1, 2, 3, 6, 60, 2000])
    x = [rng.randrange(v) for _ in range(n)]
    kind = rng.randrange(4)
    if kind == 0 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    elif kind == 1:  # two short runs out of step
        u = [rng.randrange(v) for _ in range(rng.randint(1, 9))]
        x = x[:20] + u * rng.randint(1, 30) + u[:rng.randint(0, len(u))] + u * rng.randint(1, 30)
    elif kind == 2:  # runs within runs
        u = ([rng.randrange(v) for _ in range(3)] * rng.randint(1, 12) + [rng.randrange(v) for _ in range(rng.randint(0, 30))])
        x = x[:30] + u * 3 + u[:rng.randint(0, len(u))] + x[30:60]
    return np.array(x, np.int64)


@given(st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_runs_against_every_lag(rng):
    docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
    for words, got in zip(docs, runs.runs_of(docs)):
        assert got == plain(words.tolist())


def test_many_seeds_and_many_lags():
    """Texts of few different words, that every scale must search at every lag."""
    for words in ([0] * 3000, [0, 1] * 700 + [0] + [0, 1] * 700, [0] * 900 + [1, 2] + [0] * 900):
        assert runs.runs_of([np.array(words)])[0] == plain(words)


def want(doc_id, text, edit):
    words = (text or "").encode().split()
    loop = planted_loop(doc_id, len(words)) if edit and words else None
    if loop:
        a, p = loop
        words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
    found = plain(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    return found, b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_planted_loop():
    hit = [d for d in range(200) if planted_loop(d, 100)]
    assert hit == [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0] and hit
    for d in hit:
        g = zlib.crc32(str(d).encode()) // 10
        a, p = planted_loop(d, 100)
        assert a == g % 100 and p == 1 + int((100 - a) / (3 + g % 8))
    assert planted_loop(None, 5) is None


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect() if len(r.text or "") < 12_000}
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, SF01).collect()}
    seen = 0
    for doc_id, text in docs.items():
        found, kept = want(doc_id, text, True)
        seen += bool(found)
        s, size, q = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        assert tuple(rows[doc_id]) == (doc_id, len(found), s, size, q, 1000 * size // q if found else None,
                                       hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert seen > 20


def test_odd_rows(odd, none):
    got = runs.periodic_runs(odd.repartition(4)).collect()
    given_rows = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert len(got) == len(given_rows)
    expected = {}
    for r in odd.collect():
        found, kept = want(r.doc_id, r.text, False) if r.doc_id != 106 else ([(0, 20_000, 1)], b"long a@b.example 4111 1111 1111 1111")
        expected.setdefault((str(r.doc_id), kept), []).append(found)
    for r in got:
        assert [tuple(x) for x in r.runs] in expected[str(r.id), bytes(r.kept)]
    assert runs.periodic_runs(none).collect() == []


def test_short_and_long_batches_agree(spark, monkeypatch):
    rng = random.Random(2)
    docs = [repetitive(rng) for _ in range(12)]
    at_once = runs.runs_of(docs)
    assert at_once == [runs.runs_of([d])[0] for d in docs]
