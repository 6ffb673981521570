"""Removal of byte strings that an earlier document holds too, by suffix sorting
with bucket-pointer refinement.

A text's windows of ``length`` bytes are cut into stretches that share their
least hashed anchor, so that equal windows meet at equal anchors.  The texts are
dealt once, by their hash, into parts of bounded size; each part tells which
anchors it holds and learns which of them other documents hold too.  Only
stretches at shared anchors travel, with their bytes, to buckets of their
anchor.  A bucket sorts their suffixes: initial buckets by their first bytes are
refined by the bucket pointers of later offsets, and the refined pointers serve
the next refinement, until ``length`` bytes are told apart.  Windows that keep
one bucket are equal; those of later documents go back to the text's part as
byte ranges to remove.

An anchor of very many documents would fill a bucket by itself, so its windows
travel one by one, dealt by all their bytes; equal ones are merged in every part
before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an anchor, and of the first buckets' keys.
ANCHOR, FIRST = 24, 8
#: Window starts whose anchors are looked up at a time.
BLOCK = 1 << 18
#: Flags of an anchor.
ALONE, SHARED, CROWDED = 0, 1, 2


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on as one number, first byte highest; zeros
    beyond the end."""
    eights = -(-len(data) // 8)
    padded = np.zeros(8 * eights + 8, np.uint8)
    padded[:len(data)] = data
    out = np.empty(8 * eights, np.uint64)
    for k in range(8):
        out[k::8] = padded[k:k + 8 * eights].view(">u8")
    return out[:len(data)]


def anchor_hashes(code: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes at each place, from the numbers of ``words8``."""
    n = max(len(code) - ANCHOR + 1, 0)
    h = code[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(FIRST, ANCHOR, FIRST):
        h ^= h >> np.uint64(31)
        h += code[at:at + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The least key of every ``w`` in a row."""
    got, have = key, 1
    while 2 * have <= w:
        got, have = np.minimum(got[:-have], got[have:]), 2 * have
    return np.minimum(got[:len(key) - w + 1], got[w - have:]) if have < w else got


class Stretches:
    """Stretches of window starts with one anchor: ``row`` of the part, first
    ``start`` in its text, number of ``windows``, the anchor's ``offset`` from
    the start and its hash ``anchor``."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        row, start, windows, offset, anchor = [], [], [], [], []
        w = length - ANCHOR + 1
        last = self.base[1:] - length  # the last window start of each row
        for a in range(0, len(self.data) - length + 1, BLOCK):
            piece = self.data[a:a + BLOCK + length - 1]
            h = anchor_hashes(words8(piece))
            keyed = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
            at = (window_minima(keyed, w) & np.uint64((1 << 20) - 1)).astype(np.int64)
            place = np.arange(a, a + len(at))
            near = slice(*(np.searchsorted(self.base, (a, a + len(at) - 1), side="right") + (-1, 0)))
            own = np.repeat(np.arange(near.start, near.stop), np.diff(np.clip(self.base[near.start:near.stop + 1], a, a + len(at))))
            ok = place <= last[own]
            at, place, own = at[ok], place[ok], own[ok]
            if not len(at):
                continue
            new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1]))))
            row.append(own[new])
            start.append(place[new] - self.base[own[new]])
            windows.append(np.diff(np.concatenate((new, [len(at)]))))
            offset.append(at[new] + a - place[new])
            anchor.append(h[at[new]])
        none = [np.zeros(0, np.int64)]
        self.row, self.start, self.windows, self.offset = (np.concatenate(x or none) for x in (row, start, windows, offset))
        self.anchor = np.concatenate(anchor) if anchor else np.zeros(0, np.uint64)

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The part's distinct anchors by (bucket, check): buckets, checks, the
        number of rows that hold each, and each stretch's place among them."""
        bucket = (self.anchor & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
        key = bucket << np.uint64(32) | self.anchor >> np.uint64(32)
        by = np.argsort(key, kind="stable")  # rows rise in each key
        sorted_key, rows = key[by], self.row[by]
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))[:len(by)]
        at = np.flatnonzero(new)
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        fresh = new | np.concatenate(([True], rows[1:] != rows[:-1]))[:len(by)]
        held = np.add.reduceat(fresh.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        distinct = sorted_key[at]
        return (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32), held.astype(np.uint32), place


def _in_order(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a part's rows, in an order that only the rows decide."""
    texts = [bytes(t) for t in pdf["text"]]
    ids = pdf["id"].to_numpy(np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def bucket_pointers(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For every place of ``data`` (strings that end at ``ends``, rising) with
    ``length`` bytes left in its string, the bucket that it shares with equal
    ``length``-byte strings, -1 elsewhere.  ``owner`` numbers each string's
    document; equal strings of one document alone may be left in one bucket with
    others of that document."""
    left = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(len(data))
    own = np.repeat(owner, np.diff(np.concatenate(([0], ends))))
    place = np.flatnonzero(left >= FIRST)
    code = words8(data)[place]
    by = np.argsort(code, kind="stable")
    place, code = place[by], code[by]
    pointer = np.full(len(data), -1, np.int64)
    new = np.concatenate(([True], code[1:] != code[:-1]))[:len(place)]
    pointer[place] = _starts(new)  # a bucket is named by its first place in suffix order
    depth = FIRST
    while depth < length:
        reach = min(depth, length - depth)
        # places still in a bucket of several documents, and with bytes to compare
        mixed = _mixed(new, own[place])
        place = place[mixed & (left[place] >= depth + reach)]
        here, later = pointer[place], pointer[place + reach]
        by = np.lexsort((later, here))
        place, here, later = place[by], here[by], later[by]
        old = np.concatenate(([True], here[1:] != here[:-1]))[:len(place)]
        new = old | np.concatenate(([True], later[1:] != later[:-1]))[:len(place)]
        inside = np.arange(len(place)) - _starts(old)
        pointer[place] = here + (inside - (np.arange(len(place)) - _starts(new)))
        depth += reach
    out = np.full(len(data), -1, np.int64)
    out[place] = pointer[place]
    return out


def _starts(new: np.ndarray) -> np.ndarray:
    """For sorted places, where each one's group starts."""
    at = np.flatnonzero(new)
    return np.repeat(at, np.diff(np.concatenate((at, [len(new)])))) if len(new) else np.zeros(0, np.int64)


def _mixed(new: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For sorted places, whether each one's group has several owners."""
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, bool)
    several = np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at)
    return np.repeat(several, np.diff(np.concatenate((at, [len(new)]))))


class Held:
    """Strings met in a bucket, each once with the smallest id that holds it and
    that document's places; later documents' places are settled at once."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.ids: list[int] = []
        self.offsets: list[int] = []
        self.places: list[list[tuple]] = []

    def add(self, text: bytes, doc: int, place: tuple, offset: int) -> bool:
        """False if an earlier document holds the string; ids must not fall."""
        k = self.at.setdefault(text, len(self.texts))
        if k == len(self.texts):
            self.texts.append(text)
            self.ids.append(doc)
            self.offsets.append(offset)
            self.places.append([place])
        elif self.ids[k] == doc:
            self.places[k].append(place)
        else:
            return False
        return True

    def later_ranges(self, length: int) -> Iterator[tuple[tuple, int, int]]:
        """(place, first, last) window of every string's range of windows that
        documents with smaller ids hold too."""
        if not self.ids:
            return
        _, owner = np.unique(np.array(self.ids, np.int64), return_inverse=True)
        # equal windows have equal anchors, so strings whose anchor one document holds need no sorting
        anchors = [t[p:p + ANCHOR] for t, p in zip(self.texts, self.offsets)]
        _, anchor = np.unique(np.array(anchors, f"S{ANCHOR}"), return_inverse=True)
        low, high = np.full(len(anchor), len(anchor)), np.full(len(anchor), -1)
        np.minimum.at(low, anchor, owner)
        np.maximum.at(high, anchor, owner)
        kept = np.flatnonzero(low[anchor] != high[anchor])
        owner, names = owner[kept], kept.tolist()
        ends = np.cumsum([len(self.texts[k]) for k in names], dtype=np.int64)
        sizes = np.diff(np.concatenate(([0], ends)))
        data = np.frombuffer(b"".join([self.texts[k] for k in names]), np.uint8)
        pointer = bucket_pointers(data, ends, owner, length)
        place = np.flatnonzero(pointer >= 0)
        string = np.searchsorted(ends, place, side="right")
        by = np.argsort(pointer[place], kind="stable")
        place, string = place[by], string[by]
        own = owner[string]
        new = np.concatenate(([True], pointer[place][1:] != pointer[place][:-1]))[:len(place)]
        at = np.flatnonzero(new)
        if not len(at):
            return
        least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.concatenate((at, [len(place)]))))
        later = own > least
        string, offset = string[later], place[later] - (ends - sizes)[string[later]]
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        cut = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1]))[:len(string)])
        last = np.concatenate((cut[1:], [len(string)]))[:len(cut)] - 1
        # windows of one stretch overlap, so what they cover is one range
        for k, a, b in zip(string[cut].tolist(), offset[cut].tolist(), offset[last].tolist()):
            for p in self.places[names[k]]:
                yield p, a, b


RECORD = np.dtype([("id", "<i8"), ("row", "<i4"), ("start", "<i4"), ("size", "u1"), ("offset", "u1")])
RANGE = np.dtype([("row", "<i4"), ("start", "<i4"), ("end", "<i4")])
NAMES = ["place", "part", "body"]
SENT = "place long, part long, body binary"


def _packed(records: np.ndarray, tail: bytes = b"") -> bytes:
    """A structured array, field by field, and what follows it, compressed."""
    return zlib.compress(len(records).to_bytes(8, "little") + b"".join(records[f].tobytes() for f in records.dtype.names) + tail, 1)


def _unpacked(body: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zlib.decompress(body)
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.empty(n, kind)
    for f in kind.names:
        size = n * kind[f].itemsize
        out[f] = np.frombuffer(raw[at:at + size], kind[f])
        at += size
    return out, raw[at:]


def _part_anchors(buckets: int, length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        bucket, check, held, _ = Stretches(_in_order(pdf)[1], length).anchors(buckets)
        rows = []
        for b in np.unique(bucket).tolist():
            a, z = np.searchsorted(bucket, (b, b + 1)).tolist()
            rows.append((b, part, (z - a).to_bytes(8, "little") + check[a:z].tobytes() + zlib.compress(held[a:z].tobytes(), 1)))
        return pd.DataFrame(rows, columns=NAMES)
    return run


def _flag_anchors(crowd: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        checks, held, parts = [], [], []
        for part, body in zip(pdf["part"], pdf["body"]):
            n = int.from_bytes(body[:8], "little")
            checks.append(np.frombuffer(body[8:8 + 4 * n], np.uint32))
            held.append(np.frombuffer(zlib.decompress(body[8 + 4 * n:]), np.uint32))
            parts.append((int(part), n))
        every = np.concatenate(checks)
        _, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, np.concatenate(held))[place]
        flag = np.where(total > crowd, CROWDED, np.where(total > 1, SHARED, ALONE)).astype(np.uint8)
        at, rows = 0, []
        for part, n in parts:
            rows.append((int(pdf["place"].iloc[0]), part, zlib.compress(flag[at:at + n].tobytes(), 1)))
            at += n
        return pd.DataFrame(rows, columns=NAMES)
    return run


def _send_stretches(buckets: int, into: int, length: int):
    def run(docs: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(flags):
            return pd.DataFrame([], columns=NAMES)
        part = int(docs["part"].iloc[0])
        ids, texts = _in_order(docs)
        cut = Stretches(texts, length)
        place = cut.anchors(buckets)[3]
        flag = np.frombuffer(b"".join(zlib.decompress(b) for _, b in sorted(zip(flags["place"], flags["body"]))), np.uint8)[place]
        chosen = np.flatnonzero(flag != ALONE)
        to = (((cut.anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(into))[chosen]
        sent: dict[int, tuple[list, list]] = {b: ([], []) for b in range(into)}
        settled = []
        held = Held()
        columns = (cut.row, ids[cut.row], cut.start, cut.windows, cut.start + cut.offset, flag == CROWDED)
        for row, doc, start, windows, anchor, crowded, bucket in zip(*(c[chosen].tolist() for c in columns), to.tolist()):
            text = texts[row]
            for at in range(start, start + windows) if crowded else (start,):
                size = 1 if crowded else windows
                own = text[at:at + size + length - 1]
                if held.add(own, doc, (row, at), anchor - at):
                    records, bodies = sent[zlib.crc32(own) % into if crowded else bucket]
                    records.append((doc, row, at, size, anchor - at))
                    bodies.append(own)
                else:
                    settled.append((row, at, at + len(own)))
        rows = [(b, part, _packed(np.array(records, RECORD), b"".join(bodies)))
                for b, (records, bodies) in sent.items() if records]
        if settled:
            rows.append((-1 - part, part, _packed(np.array(settled, RANGE))))
        return pd.DataFrame(rows, columns=NAMES)
    return run


def _find_ranges(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["place"].iloc[0] < 0:  # settled in the part itself
            return pdf[NAMES]
        records, parts, bodies = [], [], []
        for part, body in sorted(zip(pdf["part"], pdf["body"])):
            own, text = _unpacked(body, RECORD)
            sizes = own["size"].astype(np.int64) + length - 1
            ends = np.cumsum(sizes)
            bodies += [text[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
            records.append(own)
            parts.append(np.full(len(own), part))
        every, parts = np.concatenate(records), np.concatenate(parts)
        held, later = Held(), {}
        order = np.argsort(every["id"], kind="stable")
        every, parts = every[order], parts[order].tolist()
        for k, part, (doc, row, start, size, offset) in zip(order.tolist(), parts, every.tolist()):
            if not held.add(bodies[k], doc, (part, row, start), offset):
                later.setdefault(part, []).append((row, start, start + size + length - 1))
        for (part, row, start), a, b in held.later_ranges(length):
            later.setdefault(part, []).append((row, start + a, start + b + length))
        place = int(pdf["place"].iloc[0])
        return pd.DataFrame([(place, part, _packed(np.array(r, RANGE))) for part, r in later.items()], columns=NAMES)
    return run


def _remove(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    ids, texts = _in_order(docs) if len(docs) else ([], [])
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    edge = np.zeros(base[-1] + len(texts) + 1, np.int32)  # one place between texts
    own_base = base + np.arange(len(base))
    for body in found["body"]:
        ranges, _ = _unpacked(body, RANGE)
        np.add.at(edge, own_base[ranges["row"]] + ranges["start"], 1)
        np.add.at(edge, own_base[ranges["row"]] + ranges["end"], -1)
    gone = np.cumsum(edge) > 0
    rows = []
    for k, (doc, text) in enumerate(zip(ids, texts)):
        own = gone[own_base[k]:own_base[k] + len(text)]
        turn = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
        spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2])]
        kept = np.frombuffer(text, np.uint8)[~own].tobytes() if spans else text
        rows.append((doc, len(text), spans, kept))
    return pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   part_bytes: int = 6 << 20, bucket_bytes: int = 16 << 20, crowd: int = 20_000) -> DataFrame:
    """One row per document: ``id``, ``n_bytes`` (UTF-8), ``spans`` (the byte
    ranges removed, ``start`` to ``end``, end exclusive, apart from each other)
    and ``kept`` (the other bytes).

    Removed is every byte in a ``length``-byte string (at least 50) that starts
    in a document with a smaller id too, as the texts come in.  What a text
    repeats of itself, or of a row with the same id, stays.

    A NULL or empty text has no bytes; a text shorter than ``length`` and one
    with a NULL id keep all theirs, and a NULL id removes nothing elsewhere.
    Repeated rows give repeated results; an empty table gives no rows.  Texts
    are taken whole, however long.  ``part_bytes`` and ``bucket_bytes`` bound
    what a task holds (one document at least); a string in more than ``crowd``
    documents is dealt by its windows.  Names of extra columns do not matter."""
    if length < 50:
        raise ValueError("length must be at least 50")
    raw = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), raw.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    buckets = max(1, -(-total // (4 * part_bytes)))  # an anchor takes 5 bytes of every 14
    into = max(1, -(-total * 9 // (2 * bucket_bytes)))  # were every stretch to travel
    known = rows.where("id IS NOT NULL")
    dealt = known.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    told = dealt.groupBy("part").applyInPandas(_part_anchors(buckets, length), SENT)
    flags = told.groupBy("place").applyInPandas(_flag_anchors(crowd), SENT)
    sent = dealt.groupBy("part").cogroup(flags.groupBy("part")).applyInPandas(_send_stretches(buckets, into, length), SENT)
    found = sent.groupBy("place").applyInPandas(_find_ranges(length), SENT)
    schema = "id long, n_bytes long, spans array<struct<start long, end long>>, kept binary"
    out = dealt.groupBy("part").cogroup(found.groupBy("part")).applyInPandas(_remove, schema)
    whole = rows.where("id IS NULL").selectExpr("id", "CAST(octet_length(text) AS LONG) AS n_bytes",
                                                "CAST(array() AS array<struct<start: bigint, end: bigint>>) AS spans", "text AS kept")
    return out.unionByName(whole)
