"""Hashed n-gram indicators of whole texts, and the labelled samples that the
classifiers learn from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.common import fold, hash_below, sample_share

#: Features are hashed into so many columns.
DIM = 1 << 20
#: A worker forgets its word cache beyond so many words.
CACHE = 300_000

_RUN = re.compile(r"(.)\1+")


def _hash(kind: int, name: bytes) -> int:
    return xxhash.xxh32_intdigest(name, seed=kind)


def shape(word: str) -> str:
    """Letters as A or a, digits as 9, other characters as they are, runs cut to one."""
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Features:
    """Turns texts into sorted arrays of distinct feature columns.

    Kinds: lower-cased words and, on request, word pairs, word beginnings,
    word shapes with their pairs, and marks for repetition (the longest run of
    one word, the share of words that repeat the one before, the share of
    repeated lines).  Any text has a value, an empty
    one no feature but the repetition marks."""

    def __init__(self, pairs: bool = True, beginnings: tuple[int, ...] = (), shapes: bool = True, repeats: bool = True):
        self.pairs, self.beginnings, self.shapes, self.repeats = pairs, beginnings, shapes, repeats
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, 2 + len(self.beginnings)), np.uint32)

    def _row(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        starts = tuple(_hash(10 + n, low[:n].encode()) for n in self.beginnings)
        return (_hash(0, low.encode()), _hash(1, shape(text).encode()), *starts)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        if len(ids) > CACHE:
            self._forget()
            ids = self.ids
        try:
            at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
                    self.rows.append(self._row(w))
            at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if len(self.table) <= at.max():
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table):], np.uint32)])
        return self.table[at]

    def of(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        words = text.split()
        found = []
        if words:
            rows = self._look_up(words)
            w, s = rows[:, 0], rows[:, 1]
            found += [w, *(rows[:, 2 + i] for i in range(len(self.beginnings)))]
            if self.pairs:
                found.append(w[:-1] * np.uint32(0x9E3779B1) + w[1:] + np.uint32(7))
            if self.shapes:
                found += [s, s[:-1] * np.uint32(0x85EBCA6B) + s[1:] + np.uint32(11)]
        if self.repeats:
            found.append(np.array([_hash(2, mark) for mark in self._marks(text, words)], np.uint32))
        return np.unique(np.concatenate(found) % DIM).astype(np.int32) if found else np.zeros(0, np.int32)

    def _marks(self, text: bytes, words: list[bytes]) -> Iterator[bytes]:
        longest, same = 0, 0.0
        if words:
            ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            edge = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
            longest, same = int(np.diff(edge).max()), 1 - (len(edge) - 1) / len(ids)
        yield b"run %d" % min(longest, 6)
        yield b"same %d" % int(10 * same)
        lines = text.split(b"\n")
        yield b"lines %d" % int(10 * (1 - len(set(lines)) / len(lines)))


def learnable(labels: DataFrame, target: str, parts: int, kept_out: int) -> DataFrame:
    """Distinct (``doc_id``, ``label``) of the rows outside the held-out fold;
    NULL ids and labels are left aside."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold("doc_id", parts) != kept_out)) \
        .select(labels["doc_id"], labels[target].cast("int").alias("label")).distinct()


def bounded(rows: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``rows`` (a distinct ``doc_id``, ``label`` each),
    chosen by a seeded hash of the id; all, if there are fewer."""
    return rows.where(hash_below(sample_share(rows.count(), bound), "doc_id", seed=seed))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(``doc_id``, ``label``, ``text``) of a bounded sample, one row each however
    often the document is repeated.  The broadcast side is the sample, whose
    size its bound proves."""
    own = docs.select(docs["doc_id"], docs["text"].cast("binary").alias("text"))
    return own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_in_one_task(texts: DataFrame, make: Callable[[], Features], fit: Callable[[list[np.ndarray], np.ndarray], bytes]) -> bytes | None:
    """Extract features of a bounded sample in parallel, fit in one task on an
    executor, and return the fitted model; None for an empty sample."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = make()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"],
                                "x": [features.of(t).tobytes() for t in pdf["text"]]})

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "label"])
        model = fit([np.frombuffer(x, np.int32) for x in pdf["x"]], pdf["label"].to_numpy())
        return pd.DataFrame({"model": [model]})

    rows = texts.mapInPandas(extract, "doc_id long, label int, x binary")
    found = rows.groupBy().applyInPandas(train, "model binary").first()
    return bytes(found["model"]) if found else None


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and row numbers of a sparse 0/1 matrix."""
    return (np.concatenate(rows) if rows else np.zeros(0, np.int32),
            np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
