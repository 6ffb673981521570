"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into ``(max_bits + 1) // 2`` segments, so that two
fingerprints within ``max_bits`` bits agree up to one bit in at least one
segment (three bits over two segments).  Every distinct fingerprint is indexed
under each one-wildcard variant of each segment: the segment with one bit
deleted, together with which bit.  Fingerprints that share a variant meet by
equality, and the full bit distance is verified.

Meeting never emits all pairs of a bucket: each bucket gives a spanning forest
of its links, which has the same components.  A bucket above ``bucket_limit``
is cut further by equal chunks of the bits outside its segment, and one that
is still above the limit is compared in blocks, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.common import components, cut, row_hash, words

BITS = 64
#: Buckets up to this many fingerprints are searched pair by pair in one go.
SMALL = 24


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text: bit ``i`` is set if it is
    set in over half of the shingles' XXH64 hashes; 0 without words."""
    own = words(text)
    if not own:
        return 0
    n = max(1, len(own) - shingle + 1)
    runs = map(b" ".join, zip(*(own[i:] for i in range(shingle)))) if len(own) >= shingle else [b" ".join(own)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), "<u8", n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return of(text.cast("binary"))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at
    most one bit when the whole differs by at most ``max_bits``."""
    count = max(1, (max_bits + 2) // 2)
    edge = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _signed(mask: int) -> str:
    """An unsigned 64-bit mask as a SQL long."""
    return f"cast('{mask - (1 << 64) if mask >> 63 else mask}' AS bigint)"


def variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """One row (``seg``, ``bit``, ``key``, ``fp``) per segment and deleted bit."""
    each = []
    for s, (low, width) in enumerate(segments(max_bits)):
        field = f"(shiftrightunsigned(fp, {low}) & {_signed((1 << width) - 1)})"
        each += [f"struct({s} AS seg, {j} AS bit, {field} & {_signed((1 << 64) - 1 - (1 << j))} AS key)" for j in range(width)]
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(each)})")).alias("v")).select("v.*", "fp")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # signed numbers would count the bits of their absolute value


def _forest(fps: np.ndarray, max_bits: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among ``fps``; with ``side``,
    of the links between its two sides only."""
    todo = np.arange(len(fps))
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            u = queue.pop()
            near = _distance(fps[u], fps[todo]) <= max_bits
            if side is not None:
                near &= side[todo] != side[u]
            found = todo[near]
            if len(found):
                yield np.full(len(found), fps[u]), fps[found]
                queue.extend(found)
                todo = todo[~near]


def _bucket_edges(batches: Iterator[pd.DataFrame], keys: list[str], max_bits: int, limit: int | None) -> Iterator[pd.DataFrame]:
    """Links of every bucket of a stream sorted by ``keys``.  Rows out: ``a``,
    ``b`` for a link; ``a`` and the bucket's keys, ``b`` NULL, for a member of a
    bucket above ``limit``, which is handed on as it streams by.

    Two equal segments share every variant; their link counts in the variant
    of bit 0 alone, the others look at pairs that differ in the deleted bit."""
    lows = np.array([low for low, _ in segments(max_bits)])
    held: pd.DataFrame | None = None
    over: tuple | None = None

    def rows(a, b, frame=None):
        out = pd.DataFrame({"a": np.asarray(a, np.int64)})
        out["b"] = pd.array(b, dtype="Int64") if b is not None else pd.array([None] * len(out), dtype="Int64")
        for k in keys:
            out[k] = frame[k].to_numpy() if frame is not None else 0
        return out

    def whole(frame: pd.DataFrame):
        fps = frame["fp"].to_numpy().astype(np.int64)
        names = frame[keys].to_numpy()
        first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[first, len(fps)])
        size_at = np.repeat(sizes, sizes)
        place = np.arange(len(fps)) - np.repeat(first, sizes)
        bit = frame["bit"].to_numpy()
        value = (fps >> (lows[frame["seg"].to_numpy()] + bit)) & 1
        # small buckets: compare each row with the d-th after it
        for d in range(1, min(SMALL, sizes.max()) if len(sizes) else 0):
            i = np.flatnonzero((size_at <= SMALL) & (place + d < size_at))
            if not len(i):
                continue
            i = i[(_distance(fps[i], fps[i + d]) <= max_bits) & ((bit[i] == 0) | (value[i] != value[i + d]))]
            if len(i):
                yield rows(fps[i], fps[i + d])
        for at, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
            if limit and n > limit:
                yield rows(fps[at:at + n], None, frame.iloc[at:at + n])
                continue
            for a, b in _forest(fps[at:at + n], max_bits, value[at:at + n] if bit[at] else None):
                yield rows(a, b)

    for batch in batches:
        if over is not None:
            same = (batch[keys].to_numpy() == np.array(over)).all(axis=1)
            n = int(same.sum())
            if n:
                yield rows(batch["fp"].to_numpy()[:n], None, batch.iloc[:n])
            if n == len(batch):
                continue
            over, batch = None, batch.iloc[n:]
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        names = held[keys].to_numpy()
        last = len(held) - int((names == names[-1]).all(axis=1).sum())
        if last:
            yield from whole(held.iloc[:last])
            held = held.iloc[last:]
        if limit and len(held) > limit:
            yield rows(held["fp"].to_numpy(), None, held)
            over, held = tuple(names[-1]), None
    if held is not None and len(held):
        yield from whole(held)


def _meet(rows: DataFrame, keys: list[str], max_bits: int, limit: int | None) -> DataFrame:
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(
        partial(_bucket_edges, keys=keys, max_bits=max_bits, limit=limit), f"a long, b long, {kinds}")


def _blocks(rows: DataFrame, keys: list[str], max_bits: int, limit: int) -> DataFrame:
    """Links of buckets of any size: each is dealt into blocks of about
    ``limit`` rows, and each pair of blocks is searched as a group of its own."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    dealt = rows.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *keys, "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        side = (pdf["block"] == i).to_numpy() if i != j else None
        found = list(_forest(pdf["fp"].to_numpy().astype(np.int64), max_bits, side))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found] or [np.array([], np.int64)]),
                             "b": np.concatenate([y for _, y in found] or [np.array([], np.int64)])})

    return pairs.groupBy(*keys, "i", "j").applyInPandas(links, "a long, b long")


def near_links(fps: DataFrame, max_bits: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Links (``a``, ``b``) that join the distinct fingerprints ``fps.fp`` into
    the components of "at most ``max_bits`` differing bits"."""
    level = [cut(_meet(variants(fps, max_bits), ["seg", "bit", "key"], max_bits, bucket_limit))]
    links = level[0].where("b IS NOT NULL").select("a", "b")
    over = level[0].where("b IS NULL").select("seg", "bit", "key", F.col("a").alias("fp"))
    if over.isEmpty():
        return links
    # Outside its segment a linked pair differs in at most max_bits bits, so
    # one of max_bits + 1 chunks of those bits is equal.
    cuts = []
    for s, (low, width) in enumerate(segments(max_bits)):
        outside = [i for i in range(BITS) if not low <= i < low + width] or list(range(BITS))
        step = -(-len(outside) // (max_bits + 1))
        for c in range(max_bits + 1):
            mask = sum(1 << i for i in outside[c * step:(c + 1) * step])
            cuts.append(f"struct({s} AS s, {c} AS chunk, fp & {_signed(mask)} AS part)")
    finer = over.select("seg", "bit", "key", "fp", F.explode(F.expr(f"filter(array({', '.join(cuts)}), x -> x.s = seg)")).alias("c"))
    finer = finer.select("seg", "bit", "key", "c.chunk", "c.part", "fp")
    keys = ["seg", "bit", "key", "chunk", "part"]
    level.append(cut(_meet(finer, keys, max_bits, bucket_limit)))
    rest = level[1].where("b IS NULL").select(*keys, F.col("a").alias("fp"))
    links = links.union(level[1].where("b IS NOT NULL").select("a", "b"))
    return links if rest.isEmpty() else links.union(_blocks(rest, keys, max_bits, bucket_limit))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                    seed: int = 42, max_bits: int = 3, bucket_limit: int = 4096, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (signed long), the ``carry``
    columns, ``group`` (the smallest fingerprint of the component) and
    ``component``, the smallest id of all rows whose fingerprints are reachable
    over links of at most ``max_bits`` differing bits.

    NULL and wordless texts have fingerprint 0, linked like any other.  Rows
    with a NULL id take part in links; a component in which every id is NULL is
    named NULL.  Repeated rows stay repeated.  An empty table gives no rows.
    Other columns of ``docs`` are not looked at."""
    rows = cut(docs.select(docs[id_col].alias("id"), fingerprint(docs[text_col], shingle, seed).alias("fp"), *carry))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    named = components(near_links(fps.select("fp"), max_bits, bucket_limit))
    group = cut(fps.join(named, fps["fp"] == named["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("group")))
    lowest = group.groupBy("group").agg(F.min("low").alias("component"))
    return rows.join(group.join(lowest, "group").select("fp", "group", "component"), "fp")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their
    component: the one with the smallest id (NULL ids last, ties by a hash of
    the row), once if that very row is repeated."""
    content = row_hash(docs)
    own = cut(near_duplicates(docs, id_col, text_col, carry=(content.alias("content"),), **options))
    best = own.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "content")).alias("w"))
    best = best.select(F.col("w.id").alias("win_id"), F.col("w.content").alias("win_content"))
    same = own["id"].eqNullSafe(best["win_id"]) & (own["content"] == best["win_content"])
    wins = own.join(best, same, "left_semi").groupBy("id", "content").agg(F.count("*").alias("times"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[id_col].alias("doc_key"), content.alias("doc_content"))
    kept = packed.join(wins, packed["doc_key"].eqNullSafe(wins["id"]) & (packed["doc_content"] == wins["content"]))
    repeated = kept.where("times > 1").dropDuplicates(["doc_key", "doc_content"])
    return kept.where("times = 1").select("doc.*").union(repeated.select("doc.*"))
