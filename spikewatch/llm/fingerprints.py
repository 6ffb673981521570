"""Document fingerprints: SimHash over weighted terms, and the search for all
fingerprints within a Hamming radius by permuted block tables.

Terms are pairs of adjacent lower-cased words (the word itself in a text of one
word); a term's weight grows with the logarithm of its frequency.  Each term's
hash votes with its weight on the sign of every bit.

Search: the bits are cut into blocks.  Two fingerprints within ``radius`` bits
agree on all but ``radius`` blocks, so each choice of ``blocks - radius`` blocks
is a table keyed by those blocks; fingerprints that meet in a table are
verified in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spikewatch.llm.common import cut, cut_in_small_batches, words

#: A worker forgets its word hashes beyond so many words.
CACHE = 100_000


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finalizer: every salt gives other bits."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Fingerprinter:
    """Fingerprints of ``bits`` bits (a multiple of 64) as bytes."""

    def __init__(self, bits: int = 256):
        self.bits = bits
        self.known: dict[bytes, int] = {}
        self.of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)

    def _hashes(self, own: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in own:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes and their weights."""
        h = self._hashes(words(text))
        if len(h) > 1:
            h = _mixed(h[:-1], 1) + h[1:]
        found, count = np.unique(h, return_counts=True)
        return found, 1 + np.log(count)

    def of(self, text: bytes) -> bytes:
        """All bits zero for a text without words."""
        found, weight = self.terms(text)
        if not len(found):
            return bytes(self.bits // 8)
        width = self.bits // 8
        salted = np.stack([_mixed(found, 100 + k) for k in range(self.bits // 64)], axis=1).view(np.uint8).reshape(-1, width)
        votes = np.zeros(width * 256)
        for at in range(0, len(found), 1 << 15):
            part = salted[at:at + (1 << 15)]
            slots = part.astype(np.int64) + np.arange(width) * 256
            votes += np.bincount(slots.ravel(), np.repeat(weight[at:at + (1 << 15)], width), width * 256)
        ones = votes.reshape(width, 256) @ self.of_byte
        return np.packbits(2 * ones > weight.sum(), axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the differing bits estimate, 0 if negative."""
    differ = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * differ / (8 * len(a)))))


def spliced(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first
    ones of ``following``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(make: Fingerprinter, name, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    edited = spliced(text, following).encode()
    other = make.of(edited)
    return name, len(text), hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, next_own)


def fingerprints(docs: DataFrame, bits: int = 256, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_chars``, ``fingerprint``, and
    of the text spliced with the next document's (``spliced``):
    ``edited_sha256``, ``edited_fingerprint``, ``near_edited``; ``near_next`` is
    the likeness to the next document.

    The next document is the next one by ascending id, NULL ids first, rows of
    one id by a hash of their text; after the last comes the
    first, so a single document follows itself.  NULL texts are empty.  An
    empty table gives no rows; other columns are not looked at.

    Documents are dealt into ranges of the id and read in order; the last
    document of a range meets the first one of the next in a join of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, part = Fingerprinter(bits), TaskContext.get().partitionId()
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "edge", "text"]
        blank = (None, None, None, None, None)
        held = None
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["doc_id"], pdf["text"]):
                name = None if pd.isna(name) else int(name)
                own = make.of(text.encode())
                if held is None:
                    rows.append((name, None, None, own, *blank[:3], part, "first", text))
                else:
                    rows.append((*_row(make, *held, text, own), part, None, None))
                held = (name, text, own)
            yield _typed(pd.DataFrame(rows, columns=columns))
        if held is not None:
            name, text, own = held
            yield _typed(pd.DataFrame([(name, None, None, own, *blank[:3], part, "last", text)], columns=columns))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprinter(bits)
        for pdf in batches:
            rows = [(*_row(make, None if pd.isna(n) else int(n), t, bytes(f), nt, bytes(nf)), 0, None, None) for n, t, f, nt, nf in
                    zip(pdf["doc_id"], pdf["text"], pdf["fingerprint"], pdf["next_text"], pdf["next_fingerprint"])]
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                              "near_edited", "near_next", "part", "edge", "text"])
            yield _typed(out)[["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]]

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    own = own.withColumn("draw", F.xxhash64("text"))
    spread = own.repartitionByRange("doc_id", "draw").sortWithinPartitions("doc_id", "draw")
    seen = cut_in_small_batches(spread.mapInPandas(run, f"{_ROW}, part int, edge string, text string"))
    inner = seen.where("edge IS NULL").drop("part", "edge", "text")
    starts = seen.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("fingerprint").alias("next_fingerprint"),
                                                 F.col("text").alias("next_text"))
    # two numbers per range find the range that follows each
    parts = seen.where("edge = 'first'").select("part")
    whole = Window.orderBy("part")
    after = parts.select(F.col("part").alias("own_part"), F.coalesce(
        F.lead("part").over(whole), F.first("part").over(whole.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    ends = seen.where("edge = 'last'").join(after, F.col("part") == F.col("own_part")).join(starts, F.col("after") == F.col("next_part"))
    edges = cut(ends.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInPandas(meet, _ROW))
    return inner.union(edges)


def _typed(pdf: pd.DataFrame) -> pd.DataFrame:
    for c in ("doc_id", "n_chars"):
        pdf[c] = pdf[c].astype("Int64")
    for c in ("near_edited", "near_next"):
        pdf[c] = pdf[c].astype("Float64")
    return pdf


def _block(start: int, end: int) -> Column:
    """The bits from ``start`` to ``end`` of ``fp``, as hexadecimal text."""
    first, last = start // 8, (end - 1) // 8
    whole = F.hex(F.substring("fp", first + 1, last - first + 1))
    if start % 8 == 0 and end % 8 == 0:
        return whole
    shifted = F.shiftright(F.conv(whole, 16, 10).cast("long"), 8 * (last + 1) - end)
    return F.hex(shifted.bitwiseAND(F.lit((1 << (end - start)) - 1)))


def _tables(fps: DataFrame, bits: int, radius: int, blocks: int) -> DataFrame:
    """The columns of ``fps`` (``fp`` and others) with ``table`` and ``key``, one
    row per choice of blocks."""
    edges = [bits * b // blocks for b in range(blocks + 1)]
    if blocks <= radius or max(b - a for a, b in zip(edges, edges[1:])) > 48 and bits // 8 % blocks:
        raise ValueError("blocks must be more than the radius, and of at most 48 bits or whole bytes")
    keys = [F.struct(F.lit(t).alias("table"), F.concat_ws(".", *[_block(edges[b], edges[b + 1]) for b in chosen]).alias("key"))
            for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    return fps.select("*", F.explode(F.array(*keys)).alias("at")).select(*fps.columns, "at.table", "at.key")


def differing(a: str, b: str, bits: int) -> Column:
    """Differing bits of two binary columns, seven bytes at a time."""
    total = F.lit(0)
    for at in range(1, bits // 8 + 1, 7):
        one, other = (F.conv(F.hex(F.substring(c, at, 7)), 16, 10).cast("long") for c in (a, b))
        total = total + F.bit_count(one.bitwiseXOR(other))
    return total


def within(fps: DataFrame, queries: DataFrame, radius: int = 12, blocks: int = 13, bits: int = 256) -> DataFrame:
    """All pairs (``query``, ``fp``, ``differ``) of a fingerprint in
    ``queries.query`` and one in ``fps.fp``, both distinct, that differ in at
    most ``radius`` bits; a query that is in ``fps`` finds itself.  Texts with
    equal fingerprints are one entry, which the caller counts."""

    index = _tables(fps.select("fp"), bits, radius, blocks)
    asked = _tables(queries.select(F.col("query").alias("fp")), bits, radius, blocks) \
        .select(F.col("fp").alias("query"), F.col("table").alias("t"), F.col("key").alias("k"))
    met = asked.join(index, (F.col("t") == F.col("table")) & (F.col("k") == F.col("key"))).select("query", "fp").distinct()
    return met.withColumn("differ", differing("query", "fp", bits)).where(F.col("differ") <= radius)


def with_neighbours(rows: DataFrame, queries: Column, radius: int = 12, blocks: int = 13, bits: int = 256) -> DataFrame:
    """The rows of ``fingerprints()`` with ``near_docs``: for those with
    ``queries`` true, how many other documents have a fingerprint within
    ``radius`` bits; NULL for the others."""
    asks = rows.where(F.coalesce(queries, F.lit(False)))
    classes = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).select(F.col("fingerprint").alias("fp"), "n")
    pairs = within(classes.select("fp"), asks.select(F.col("fingerprint").alias("query")).distinct(), radius, blocks, bits)
    sizes = classes.select(F.col("fp").alias("member"), "n")
    near = pairs.join(sizes, F.col("fp") == F.col("member")).groupBy("query").agg((F.sum("n") - 1).alias("near_docs"))
    found = asks.join(near, F.col("fingerprint") == F.col("query")).drop("query")
    return rows.where(~F.coalesce(queries, F.lit(False))).withColumn("near_docs", F.lit(None).cast("long")).unionByName(found)
