"""Packing token streams into fixed windows by best-fit decreasing.

Every document is its token ids and an end id.  Overlong documents are first
cut into full windows and a rest; the pieces are placed from the longest to the
shortest, each into the open window with the least room that still takes it,
found in a segment tree indexed by remaining room.  What room is left is then
closed by cutting: the emptiest windows are dissolved into the gaps of the
others.

Documents are packed where they are read, in runs of ``run_tokens`` tokens, so
a task holds one run.  A run hands its open window, less than one window of ids,
on to the next run of its task; what a task is left with at the end is packed
once more together with the rest of ``gather`` tasks, and only the last open
window of those is cut into parts of power-of-two length, which need no padding.
"""

from __future__ import annotations

import base64
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Generator, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.common import ensure_checkpoint_dir

#: Windows sent on at a time.
FRAME = 128


class BpeEncoder:
    """Ids of a public byte-level BPE tokenizer file.  Where the same vocabulary
    also comes as ranks, these give the same ids several times faster; texts
    with a special token's string or a very long run of blanks (which that
    library's pattern engine cannot take) go through the tokenizer file."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.held = path, None
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens") or []]
        self.long_blank = re.compile(r"\s{1000}")
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    @property
    def whole(self):
        """The tokenizer of the file, loaded when a text needs it."""
        if self.held is None:
            from tokenizers import Tokenizer

            self.held = Tokenizer.from_file(self.path)
        return self.held

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special) and not self.long_blank.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


class RoomTree:
    """Segment tree over remaining room 0..window: which rooms have an open window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` with an open window."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


Piece = tuple[int, int, int]  # document of the run, first id, length


def best_fit(lengths: list[int], window: int) -> list[list[Piece]]:
    """Windows of whole pieces: full windows of overlong documents, then best
    fit of all other pieces, longest first."""
    windows: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        full = n // window
        windows += [[(d, k * window, window)] for k in range(full)]
        if n % window:
            rest.append((d, full * window, n % window))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree, by_room = RoomTree(window), [[] for _ in range(window + 1)]
    for piece in rest:
        room = tree.tightest(piece[2])
        if room is None:
            at, room = len(windows), window
            windows.append([])
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        windows[at].append(piece)
        if left := room - piece[2]:
            by_room[left].append(at)
            tree.add(left, 1)
    return windows


def cut_off(spare: list[Piece], n: int) -> list[Piece]:
    """Pieces of ``n`` ids, or all there are, from the end of ``spare``."""
    got: list[Piece] = []
    while n and spare:
        d, start, size = spare.pop()
        if size > n:
            spare.append((d, start + n, size - n))
            size = n
        got.append((d, start, size))
        n -= size
    return got


def fill_gaps(windows: list[list[Piece]], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill open windows with pieces cut from the emptiest ones: full windows,
    and what the last open one holds."""
    fill = [sum(p[2] for p in w) for w in windows]
    done = [w for w, n in zip(windows, fill) if n == window]
    part = sorted((i for i, n in enumerate(fill) if n < window), key=lambda i: (-fill[i], i))
    spare: list[Piece] = []

    first, last = 0, len(part) - 1
    while first <= last:
        i = part[first]
        gap = window - fill[i]
        while sum(p[2] for p in spare) < gap and last > first:
            spare += windows[part[last]]
            last -= 1
        done.append(windows[i] + cut_off(spare, gap))
        first += 1
    while spare:
        done.append(cut_off(spare, window))
    left = done.pop() if done and sum(p[2] for p in done[-1]) < window else []
    return done, left


def in_powers(left: list[Piece]) -> list[list[Piece]]:
    """The pieces cut into parts of power-of-two length, the longest first."""
    spare, n, out = left[::-1], sum(p[2] for p in left), []
    while n:
        size = 1 << (n.bit_length() - 1)
        out.append(cut_off(spare, size))
        n -= size
    return out


#: Ids of a document, or a piece of it: its name, the ids, ids before, ids in all.
Item = tuple[int | None, np.ndarray, int, int]
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]


def rows_of(items: list[Item], windows: list[list[Piece]], base: int | None, with_ids: bool) -> Iterator[pd.DataFrame]:
    """The pieces of the windows, numbered from ``base``, a few windows a frame."""
    for first in range(0, len(windows), FRAME):
        rows = []
        for k, pieces in enumerate(windows[first:first + FRAME], first):
            at = 0
            for d, start, n in pieces:
                name, ids, before, total = items[d]
                own = ids[start:start + n].astype("<u4")
                rows.append((name, before + start, n, total, None if base is None else base + k, at, zlib.crc32(own.tobytes()),
                             own if with_ids else None))
                at += n
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in ("doc_id", "sequence_id"):
            out[c] = out[c].astype("Int64")
        yield out


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], *, id_col: str = "doc_id", text_col: str = "text",
         window: int = 2048, end_id: int = 1, run_tokens: int = 1 << 22, gather: int = 128, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it),
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in its sequence,
    ``ids_crc32`` (of the ids as little-endian 32-bit words) and, unless
    ``with_ids`` is off, ``ids`` (array).

    A NULL or empty text is its end id alone.  Rows with the same or a NULL id
    are documents of their own.  An empty table gives no rows; other columns
    are not looked at.  A very long text is held whole by its task, beside one
    run.  A sequence has ``window`` ids or a smaller power of two; the tasks of
    a group of ``gather`` share fewer than log2(``window``) + 1 of the latter.
    The pieces are written to the shared checkpoint folder between the passes."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/packing-{uuid.uuid4().hex}"

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        end = np.array([end_id], np.uint32)
        task = TaskContext.get().partitionId()
        base, items, held = task << 33, [], 0

        def run() -> Generator[pd.DataFrame, None, list[Item]]:
            nonlocal base
            done, left = fill_gaps(best_fit([len(i[1]) for i in items], window), window)
            for out in rows_of(items, done, base, with_ids):
                yield out.assign(task=task, rest=False)
            base += len(done)
            return [(items[d][0], items[d][1][start:start + n].copy(), items[d][2] + start, items[d][3]) for d, start, n in left]

        for pdf in batches:
            for name, text in zip(pdf["doc_id"], pdf["text"]):
                own = np.concatenate([encode(text), end]) if text else end
                items.append((None if pd.isna(name) else int(name), own, 0, len(own)))
                held += len(own)
                if held >= run_tokens:
                    items = yield from run()
                    held = sum(len(i[1]) for i in items)
        if items:
            items = yield from run()
        for out in rows_of(items, [[(d, 0, len(i[1])) for d, i in enumerate(items)]], None, True):
            yield out.assign(task=task, rest=True)

    def rests(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task", "offset"])
        items = [(None if pd.isna(name) else int(name), np.asarray(ids, np.uint32), start, total) for name, ids, start, total in
                 zip(pdf["doc_id"], pdf["ids"], pdf["start"], pdf["doc_tokens"])]
        done, left = fill_gaps(best_fit([len(i[1]) for i in items], window), window)
        base = (int(pdf["task"].min()) // gather << 33) + (1 << 32)  # beside the numbers of the first pass
        return pd.concat(rows_of(items, done + in_powers(left), base, with_ids))

    schema = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, "
              "ids array<int>")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    own.mapInPandas(tasks, f"{schema}, task int, rest boolean").write.parquet(folder)
    pieces = spark.read.schema(f"{schema}, task int, rest boolean").parquet(folder)
    again = pieces.where("rest").groupBy(F.floor(F.col("task") / gather)).applyInPandas(rests, schema)
    columns = COLUMNS if with_ids else COLUMNS[:-1]
    return pieces.where("NOT rest").select(*columns).union(again.select(*columns))


def public_bpe(path: str | None = None) -> Callable[[], Callable[[str], np.ndarray]]:
    """Maker of an encoder for a tokenizer file, by default the public byte-level
    BPE of the machine that the task runs on."""

    def make() -> Callable[[str], np.ndarray]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path is not None:
            return _encoder(path).ids
        import public_tokenizers as public

        return _encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).ids

    return make


@lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> BpeEncoder:
    """One encoder per worker process, whatever the number of its tasks."""
    return BpeEncoder(path, ranks, pattern)
