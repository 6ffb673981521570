"""Periodic runs of words, by multi-scale minimizers.

A run of period q repeats its windows at distance q, so in each scale that a
period belongs to, the least of a window's hashed word groups comes up again at
that distance.  Pairs of equal minimizers at a distance of the scale's periods
seed the search; every seed is extended word by word.  Periods too short for a
word group are found by comparing the text with itself at each lag.

Documents are searched where they are read, many at a time, so nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Periods up to this are found by direct lag scans.
SHORT = 24
#: Words in a minimizer's group.
GROUP = 8
#: Words searched at a time (one document at least).
WORDS_AT_ONCE = 1 << 17
#: Seeds per minimizer up to which they are listed; a document with more is scanned at every lag of the scale.
SEEDS = 16


def stretches(same: np.ndarray, least: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of True of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    start, size = edge[::2], edge[1::2] - edge[::2]
    keep = size >= least
    return start[keep], size[keep]


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The least key of every ``w`` in a row."""
    got, have = key, 1
    while 2 * have <= w:
        got, have = np.minimum(got[:-have], got[have:]), 2 * have
    return np.minimum(got[:len(key) - w + 1], got[w - have:]) if have < w else got


def group_hashes(ids: np.ndarray, k: int = GROUP) -> np.ndarray:
    """A 64-bit hash of every ``k`` (a power of two) ids in a row."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step = 1
    while step < k:
        h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(docs: list[np.ndarray], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """Every run (start, length, period) of each array of word ids (0 upwards),
    by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in docs]
    order = sorted((d for d in range(len(docs)) if len(docs[d]) >= least), key=lambda d: -len(docs[d]))
    if not order:
        return [[] for _ in docs]
    sizes = np.array([len(docs[d]) for d in order])
    first = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator of its own after each
    ids = np.concatenate([x for k, d in enumerate(order) for x in (docs[d], [-1 - k])]).astype(np.int64)
    doc = np.repeat(np.arange(len(order)), sizes + 1)

    def note(start: np.ndarray, size: np.ndarray, q: int) -> None:
        for s, n in zip(start.tolist(), size.tolist()):
            k = doc[s]
            found[order[k]].setdefault((s - int(first[k]), n + q), q)  # a smaller period came before

    for q in range(1, SHORT + 1):
        held = int(np.searchsorted(-sizes, -max(2 * q, least), side="right"))
        if not held:
            break
        part = ids[:first[held]]
        note(*stretches(part[:-q] == part[q:], max(q, least - q)), q)

    # the end of the run of a period within the group's length that holds a place, where there is one
    until = np.zeros(len(ids) + 1, np.int64)
    for k, d in enumerate(order):
        for (s, n), q in found[d].items():
            if q <= GROUP:
                a = int(first[k]) + s
                np.maximum(until[a:a + n], a + n, out=until[a:a + n])

    low = SHORT + 1
    while low * 2 <= sizes[0]:
        held = int(np.searchsorted(-sizes, -2 * low, side="right"))
        for k, lags in _candidates(ids[:first[held]], doc, until, low):
            a, n = int(first[k]), int(sizes[k])
            own = ids[a:a + n]
            for q in lags:
                start, size = stretches(own[:-q] == own[q:], q)
                note(start + a, size, q)
        low *= 2
    return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]


def _candidates(ids: np.ndarray, doc: np.ndarray, until: np.ndarray, low: int) -> Iterator[tuple[int, list[int]]]:
    """(document, rising lags) that may be periods from ``low`` to 2 * ``low`` - 1."""
    w = low - GROUP + 1  # a window and its copy one period on lie in any two periods
    h = group_hashes(ids)
    if len(h) < w:
        return
    room = np.uint64(len(h)).item().bit_length()
    keyed = (h >> np.uint64(room) << np.uint64(room)) | np.arange(len(h), dtype=np.uint64)
    at = np.unique(window_minima(keyed, w) & np.uint64((1 << room) - 1)).astype(np.int64)
    at = at[doc[at] == doc[at + GROUP - 1]]
    value, group = np.unique(h[at], return_inverse=True)
    by = np.argsort(group, kind="stable")  # places rise in each group
    at, group = at[by], group[by].astype(np.int64)
    span = len(ids) + 2 * low + 1
    key = group * span + at
    # what lies with a place in one run of a short period has that period's multiples alone
    near = np.maximum(at + low, np.where(until[at] >= at + GROUP, until[at] - GROUP + 1, 0))
    a = np.searchsorted(key, group * span + np.minimum(near, at + 2 * low))
    b = np.searchsorted(key, group * span + at + 2 * low)
    seeds = np.maximum(b - a, 0)
    many, all_lags = np.bincount(doc[at], seeds) > SEEDS * np.maximum(np.bincount(doc[at]), 1), {}
    for k in np.flatnonzero(many).tolist():
        n = int(np.searchsorted(doc, k + 1) - np.searchsorted(doc, k)) - 1
        all_lags[k] = range(low, min(2 * low - 1, n // 2) + 1)
    seeds[many[doc[at]]] = 0
    m = np.repeat(np.arange(len(at)), seeds)
    p = np.arange(len(m)) - np.repeat(np.cumsum(seeds) - seeds, seeds) + np.repeat(a, seeds)
    m, q = at[m], at[p] - at[m]
    same = (doc[m] == doc[m + q]) if len(m) else np.zeros(0, bool)
    m, q = m[same], q[same]
    # a stretch of q equal words that holds m holds all of the right half or all of the left one
    half, top = (q - 1) - (q - 1) // 2, len(ids) - 1
    right, left = np.ones(len(m), bool), np.ones(len(m), bool)
    for part in (1, 2, 3, 4):
        r, t = m + half * part // 4, m - (q - half) * part // 4
        right &= ids[np.minimum(r, top)] == ids[np.minimum(r + q, top)]
        left &= (ids[np.maximum(t, 0)] == ids[np.minimum(np.maximum(t, 0) + q, top)]) & (t >= 0)
    keep = right | left
    pairs = np.unique(np.stack([doc[m[keep]], q[keep]], axis=1), axis=0)
    for k in np.unique(pairs[:, 0]).tolist():
        all_lags[k] = pairs[pairs[:, 0] == k, 1].tolist()
    yield from all_lags.items()


def looped(ids: np.ndarray, a: int, p: int) -> np.ndarray:
    """The words with every one from ``a`` on replaced by ``a + (i - a) % p``."""
    i = np.arange(len(ids))
    return np.where(i < a, i, a + (i - a) % p)


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that are in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, size, q in runs:
        edge[s + q] += 1
        edge[s + size] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12,
                  loop: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``runs`` (every run's
    ``start``, ``length`` and smallest ``period`` in words, by start, then
    period) and ``kept`` (the words outside every run's repeats, joined by one
    space).

    Words are maximal runs of bytes other than ASCII white space, compared as
    they are.  A run is as long as it can be, at least ``least`` words and two
    periods.  ``loop(id, words)`` may name a word and a period from which on the
    words are made to repeat before the search.

    A NULL, empty or blank text has no words, no runs and an empty ``kept``.
    Rows with the same or a NULL id are documents of their own, repeated rows
    give repeated results, and an empty table gives no rows.  Texts are searched
    whole; one with very many equal word groups is compared with itself at
    every lag, in time that grows with its length squared.  Names of extra
    columns do not matter."""

    def flush(names: list, texts: list[list[bytes]]) -> pd.DataFrame:
        codes, _ = pd.factorize(np.array([w for t in texts for w in t], object))
        at, ids = 0, []
        for k, (name, t) in enumerate(zip(names, texts)):
            own = codes[at:at + len(t)].astype(np.int64)
            at += len(t)
            edit = loop(name, len(t)) if loop and t else None
            if edit:
                places = looped(own, *edit)
                own, texts[k] = own[places], [t[i] for i in places.tolist()]
            ids.append(own)
        found = runs_of(ids, least)
        rows = []
        for name, t, runs in zip(names, texts, found):
            kept = [t[i] for i in np.flatnonzero(collapse(len(t), runs)).tolist()] if runs else t
            rows.append((name, len(t), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept)))
        return pd.DataFrame(rows, columns=["id", "n_words", "runs", "kept"]).astype({"id": "Int64"})

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, texts, held = [], [], 0
        for pdf in batches:
            for name, text in zip(pdf["id"], pdf["text"]):
                words = bytes(text).split() if text is not None else []
                names.append(None if pd.isna(name) else int(name))
                texts.append(words)
                held += len(words) + 1
                if held >= WORDS_AT_ONCE:
                    yield flush(names, texts)
                    names, texts, held = [], [], 0
        if names:
            yield flush(names, texts)

    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    return own.mapInPandas(tasks, "id long, n_words long, runs array<struct<start long, length long, period long>>, kept binary")
