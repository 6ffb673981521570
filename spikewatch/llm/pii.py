"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. *Zones*: the stretches of a text around digits and ``@`` in which every
   format below must lie; the rest of the text is scanned once.
2. *Base spans* (fixed formats, always kept) and high-recall *generators*, whose
   spans may overlap each other and the base spans.
3. *Boosted trees* over binned features of the format and of the characters
   around it.  They learn from all candidates of all documents, counted by
   feature values (the table of counts is bounded by the product of the bins,
   ``FEATURES``).
4. *Thresholds* per kind, calibrated on texts left out of the training: the
   lowest margin down to which every level of candidates is good enough.  The
   candidates that pass, hold their own check and overlap no span already taken
   are added.

The labels come from evidence that is no input of the trees.  A candidate is a
positive case if it holds its check (Luhn, octets, digit count, domain) and
either is a card, lies in a base span of its kind, or follows a word of its
kind.  Of a level's candidates that hold their check count as wrong:

* those that overlap base spans without lying in one of their kind;
* of the cards without a word of their kind, base spans too, as many as pass
  Luhn by chance: a ninth of the candidates of that level that fail it;
* of the other kinds, those without evidence (``evidence`` is the least share
  with it).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikewatch.llm.boosting import Boosted, boost

KINDS = ("email", "ip", "card", "phone")

# Java patterns.  Quantifiers without anything to give back are possessive, and
# a match that cannot start inside a run says so, which leaves the matches as
# they are and keeps long runs linear.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": [rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9.-]++"],
    "ip": [r"(?<![0-9])[0-9]{1,3}(?:[.\x20-][0-9]{1,3}){3}(?![0-9])", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])"],
    "phone": [r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
              r"(?<![0-9])\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
              r"(?<![0-9])(?:\+|00)[0-9]{1,3}[\x20.-]{0,2}\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])"],
}
_W = "[A-Za-z0-9._%+@()-]"
_CORE = rf"[A-Za-z._%+()-]*+[0-9@]{_W}*+"
ZONE = rf"(?<!{_W}){_CORE}(?:[\x20().-]++{_CORE})*+"
#: Words before a candidate that speak for personal data of its kind, in any case.
CONTEXT = {kind: rf"(?i)(?<!\p{{L}})({some})" for kind, some in {
    "email": "e-?mail|mail|contact|write|addr", "ip": "server|host|login|addr|ip(?!\\p{L})",
    "card": "card|credit|visa|account", "phone": "tel|phone|call|fax|mobile|cell|contact"}.items()}
CONTEXT_CHARS = 24
#: Binned features and their numbers of values; the counts table has at most
#: 2 folds x their product of rows.
FEATURES = {"kind": 4, "digits": 6, "marks": 6, "start": 2, "before": 4, "after": 4, "lead": 10}
#: Evidence, no input of the trees.
EVIDENCE = ("valid", "context")
CARD = KINDS.index("card")
#: The share of numbers with any check digit that pass Luhn.
LUHN_CHANCE = 0.1


def found(text: Column, pattern: str) -> Column:
    """Matches as an array of (``s``, ``e``, ``m``, ``left``, ``right``): code
    point offsets, the match, and the text between it and its neighbours."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<s:int,e:int,m:string,left:string,right:string>>"
    near = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("left"), hits.alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("right"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["left"])
        end = start + F.length(x["m"])
        row = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).cast(kind).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(F.aggregate(near, start, step)["out"])


def zones(text: Column) -> Column:
    """(``at``, ``m``, ``left``, ``right``) of each zone, with nearby context."""
    return F.transform(found(text, ZONE), lambda z: F.struct(
        z["s"].alias("at"), z["m"].alias("m"), F.right(z["left"], F.lit(CONTEXT_CHARS)).alias("left"),
        F.left(z["right"], F.lit(1)).alias("right")))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The Luhn check of a string of digits."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def octets(match: Column) -> Column:
    """All numbers of the match are at most 255."""
    parts = F.transform(F.split(match, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: F.when(F.length(p).between(1, 3), p.cast("int") <= 255).otherwise(F.length(p) == 0))


def holds(kind: str, match: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    n = F.length(digits(match))
    if kind == "ip":
        return octets(match)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _last_of(text: Column) -> Column:
    return F.right(text, F.lit(1))


def _char_class(char: Column) -> Column:
    return F.when(char.rlike("^[0-9]$"), 3).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike(r"^\S$"), 1).otherwise(0)


def _bins(kind: int, match: Column, left: Column, right: Column) -> dict[str, Column]:
    n = F.length(digits(match))
    marks = F.regexp_replace(match, "[A-Za-z0-9_]", "")
    valid = {"email": match.rlike(r"\.[A-Za-z]{2,}$"), "ip": octets(match), "phone": n.between(9, 15),
             "card": F.when(n.between(13, 19), luhn(digits(match))).otherwise(F.lit(False))}[KINDS[kind]]
    return {
        "kind": F.lit(kind),
        "digits": F.when(n < 4, 0).when(n < 9, 1).when(n < 11, 2).when(n < 13, 3).when(n < 17, 4).otherwise(5),
        "marks": F.when(marks == "", 0).when(marks.rlike("^[.]+$"), 1).when(marks.rlike("^-+$"), 2)
                  .when(marks.rlike("^ +$"), 3).when(marks.rlike("[@]"), 4).otherwise(5),
        "start": match.rlike(r"^(\+|[A-Za-z])").cast("int"),
        "before": _char_class(_last_of(left)),
        "after": _char_class(F.left(right, F.lit(1))),
        "lead": F.left(match, F.lit(1)).cast("int") if kind == CARD else F.lit(0),
        "valid": valid.cast("int"),
        "context": left.rlike(CONTEXT[KINDS[kind]]).cast("int"),
    }


def _spans_in(zone: Column, kind: int, pattern: str, base: bool) -> Column:
    """Candidates of one pattern in one zone: kind ``k``, ``s``, ``e``, ``base``
    and the bins."""
    hits = found(zone["m"], pattern)
    if base:
        hits = F.filter(hits, lambda x: holds(KINDS[kind], x["m"]))

    def row(x: Column) -> Column:
        left = F.right(F.concat(zone["left"], F.left(zone["m"], x["s"])), F.lit(CONTEXT_CHARS))
        right = F.substring(F.concat(zone["m"], zone["right"]), x["e"] + 1, F.lit(1))
        bins = {} if base else _bins(kind, x["m"], left, right)
        return F.struct(F.lit(kind).alias("k"), (zone["at"] + x["s"]).alias("s"), (zone["at"] + x["e"]).alias("e"),
                        *[c.cast("int").alias(n) for n, c in bins.items()])

    return F.transform(hits, row)


def _in_order(spans: Column) -> Column:
    return F.array_sort(spans)


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``base`` (array of ``k``, ``s``, ``e``) and ``cands`` (the
    same and the bins), each in order of kind and start."""
    df = docs.withColumn("zones", zones(F.coalesce(text, F.lit(""))))
    base = F.flatten(F.transform("zones", lambda z: F.concat(*[_spans_in(z, k, BASE[name], True) for k, name in enumerate(KINDS)])))
    cands = F.flatten(F.transform("zones", lambda z: F.concat(*[
        _spans_in(z, k, p, False) for k, name in enumerate(KINDS) for p in (BASE[name], *GENERATORS[name])])))
    return df.withColumn("base", _in_order(base)).withColumn("cands", _in_order(F.array_distinct(cands)))


@dataclass
class PiiModel:
    trees: Boosted
    #: Per kind, the least margin of an added span; None adds none.
    least: list[float | None]


def train(docs: DataFrame, text_col: str = "text", precision: float = 0.98, evidence: float = 0.9, support: int = 5) -> PiiModel:
    """Count the candidates of all documents by bins, fold and evidence; boost
    on four fifths of the texts, calibrate the thresholds on the rest.  Equal
    texts are in one fold.  Only levels of ``support`` candidates that hold
    their check are judged.  Without candidates nothing is added."""
    names = list(FEATURES)
    own = docs.select(docs[text_col].alias("text")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    rows = with_candidates(own, F.col("text")).select("fold", "base", F.explode("cands").alias("c"))
    inside = F.exists("base", lambda b: (b["k"] == F.col("c.k")) & (b["s"] <= F.col("c.s")) & (F.col("c.e") <= b["e"]))
    free = ~F.exists("base", lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    rows = rows.select("fold", F.col("c.valid").alias("valid"), ((inside & (F.col("c.kind") != CARD)) | (F.col("c.context") == 1)).alias("known"), inside.alias("inside"),
                       free.alias("free"), *[F.col(f"c.{n}").alias(n) for n in names])
    holds_check, card = F.col("valid") == 1, F.col("kind") == CARD
    apart = F.col("inside") | F.col("free")
    sums = {"n": F.lit(True), "y": holds_check & (F.col("known") | card), "known": holds_check & apart & F.col("known"),
            "open": holds_check & apart & ~F.col("known"), "wrong": holds_check & ~apart, "fails": ~holds_check}
    counts = rows.groupBy("fold", *names).agg(*[F.sum(c.cast("long")).alias(f"n_{n}") for n, c in sums.items()]).orderBy("fold", *names).collect()
    bins = np.array([[r[n] for n in names] for r in counts], np.int64).reshape(-1, len(names))
    of = {n: np.array([r[f"n_{n}"] for r in counts], float) for n in sums}
    left_out = np.array([r["fold"] for r in counts], bool)
    if left_out.all():
        return PiiModel(Boosted(-10.0, []), [None] * len(KINDS))
    model = boost(bins[~left_out], of["y"][~left_out], of["n"][~left_out])
    least: list[float | None] = []
    for k in range(len(KINDS)):
        mine = left_out & (bins[:, 0] == k)
        levels, level = np.unique(-model.margin(bins[mine]), return_inverse=True)
        known, undecided, wrong, fails = (np.bincount(level, of[c][mine], len(levels)) for c in ("known", "open", "wrong", "fails"))
        n = known + undecided + wrong
        by_chance = np.minimum(undecided, (fails + 1) * LUHN_CHANCE / (1 - LUHN_CHANCE))
        fine = known + undecided - by_chance >= precision * n if k == CARD else (known >= precision * (known + wrong)) & (known >= evidence * n)
        told = n >= support  # smaller levels neither set nor stop the threshold
        good = told & np.cumprod(fine | ~told).astype(bool)
        # SQL adds the trees up in another order, which may differ in the last digit
        least.append(float(-levels[good][-1]) - 1e-6 if good.any() else None)
    return PiiModel(model, least)


def find(docs: DataFrame, text_col: str = "text", model: PiiModel | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (the row as a struct), ``text`` (NULL
    as empty), ``base`` and ``spans`` (arrays of ``k``, ``s``, ``e``: number of
    the kind in ``KINDS``, code point offsets, the end exclusive), in order of
    kind and start.  Texts without personal data have empty arrays; repeated
    rows stay repeated; names of extra columns do not matter."""
    model = model or train(docs, text_col)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    df = with_candidates(own, F.col("text"))

    def passes(c: Column) -> Column:
        margin = model.trees.column([c[n] for n in FEATURES])
        bound = F.lit(None).cast("double")
        for k, least in enumerate(model.least):
            if least is not None:
                bound = F.when(c["k"] == k, F.lit(least)).otherwise(bound)
        return F.coalesce((c["valid"] == 1) & (margin >= bound), F.lit(False))

    chosen = F.filter("cands", passes) if any(x is not None for x in model.least) else F.slice("cands", 1, 0)
    plain = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    kind = "array<struct<k:int,s:int,e:int>>"
    spans = F.aggregate(chosen, plain.cast(kind), lambda acc, c: F.when(
        F.exists(acc, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))).cast(kind)))
    return df.select("doc", "text", plain.cast(kind).alias("base"), _in_order(spans).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", model: PiiModel | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets
    (spans that overlap become one, named by the first), and ``count_col``, if
    there, brought up to date.  Texts without spans, NULL too, stay as they are."""
    df = find(docs, text_col, model)
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    kind = "array<struct<s:int,e:int,k:int>>"
    merged = F.aggregate(by_start, F.array().cast(kind), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, F.size(acc)).otherwise(1))["e"] > x["s"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(acc, F.lit(-1))["e"], x["e"]).alias("e"),
            F.try_element_at(acc, F.lit(-1))["k"].alias("k")))).cast(kind)).otherwise(F.concat(acc, F.array(x)).cast(kind)))
    df = df.withColumn("cuts", merged)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = F.transform("cuts", lambda x, i: F.concat(
        F.substring(F.col("text"), F.coalesce(F.try_element_at("cuts", F.when(i > 0, i).otherwise(F.size("cuts") + 1))["e"], F.lit(0)) + 1,
                    x["s"] - F.coalesce(F.try_element_at("cuts", F.when(i > 0, i).otherwise(F.size("cuts") + 1))["e"], F.lit(0))),
        F.element_at(name, x["k"] + 1)))
    clean = F.concat(F.array_join(pieces, ""), F.substring("text", F.element_at("cuts", -1)["e"] + 1, F.length("text")))
    df = df.withColumn("clean", F.when(F.size("cuts") > 0, clean).otherwise(F.col(f"doc.`{text_col}`")))
    cols = []
    for c, dtype in docs.dtypes:
        if c == text_col:
            cols.append(F.col("clean").alias(c))
        elif c == count_col:
            cols.append(F.when(F.size("cuts") > 0, F.length("clean").cast(dtype)).otherwise(F.col(f"doc.`{c}`")).alias(c))
        else:
            cols.append(F.col(f"doc.`{c}`").alias(c))
    return df.select(*cols)


def digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: the id, the number of base spans of each kind, the SHA-256 of
    the base spans as text, and all spans as text."""
    df = find(docs, **options)
    kinds = F.transform("base", lambda b: b["k"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in range(len(KINDS))]
    counts = [(F.size(kinds) - n).alias(f"n_{name}") for n, name in zip(counts, KINDS)]
    return df.select(F.col(f"doc.`{id_col}`").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                     as_text(F.col("spans")).alias("spans"))
