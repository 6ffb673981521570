"""Subset lattice (A7): period totals for every subset of the top values.

The naive plan filters the fact table once per subset (2^k scans).  Here the
fact table is scanned once: each row gets a mask of the test columns in which it
holds the top value (one integer per 62 columns) and is pre-aggregated by
(period, mask, descriptions of the held values) -- a skewed value collapses to
one partial row per map task.  Superset sums follow on that small result: a few
bits at a time, each mask adds its totals to those without some of these bits,
and equal masks are merged before the next bits.  Only slices that hold rows
come up, for any number of test columns up to 126 (ordinals are exact).
"""

from __future__ import annotations

from math import comb
from typing import Mapping, Sequence, Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q, slice_label_sql, slit
from ..spec import AnalysisSpec
from .series import Measure

#: Test columns per mask integer, and bits rolled up in one pass.
_WORD, _PASS = 62, 6
#: Beyond this many test columns ordinals are decimals.
_INT_BITS = 31


def _bit_sql(words: Sequence[str], i: str) -> str:
    """Whether bit ``i`` (SQL text) of the mask in ``words`` is set."""
    word = words[0] if len(words) == 1 else f"element_at(array({', '.join(words)}), CAST({i} DIV {_WORD} AS INT) + 1)"
    at = i if len(words) == 1 else f"CAST({i} % {_WORD} AS INT)"
    return f"(shiftright({word}, {at}) & 1) = 1"


def _word(subset: Sequence[int], w: int) -> int:
    """Mask integer ``w`` of a subset of column numbers."""
    return sum(1 << (i - w * _WORD) for i in subset if i // _WORD == w)


def _size_sql(words: Sequence[str]) -> str:
    return f"CAST({' + '.join(f'bit_count({w})' for w in words)} AS INT)"


def _ordinal_sql(words: Sequence[str], k: int) -> str:
    """Position of a subset (bit i of its mask = test column i) among all
    subsets of k columns by size, then lexicographically: the smaller sizes,
    plus the rank of its combination, from binomial coefficients."""
    kind = "BIGINT" if k <= _INT_BITS else "DECIMAL(38,0)"
    number = (lambda n: f"{n}L") if k <= _INT_BITS else (lambda n: f"CAST({n} AS DECIMAL(38,0))")
    size = _size_sql(words)
    before = [sum(comb(k, s) for s in range(n)) for n in range(k + 1)]
    table = ", ".join(number(comb(n, r)) for n in range(k + 1) for r in range(k + 1))
    at = f"element_at(array({table}), (%s) * {k + 1} + (%s) + 1)"
    # rank = C(k, s) - 1 - sum over the chosen c_j of C(k - 1 - c_j, s - j)
    walk = (f"aggregate(sequence(0, {k - 1}), named_struct('left', {size}, 'sum', {number(0)}), (acc, i) -> "
            f"IF({_bit_sql(words, 'i')}, named_struct('left', acc.left - 1, 'sum', CAST(acc.sum + "
            + at % (f"{k - 1} - i", "acc.left") + f" AS {kind})), acc), acc -> acc.sum)")
    starts = f"element_at(array({', '.join(number(b) for b in before)}), {size} + 1)"
    return f"CAST({starts} + {at % (str(k), size)} - 1 - {walk} AS {'INT' if k <= _INT_BITS else kind})"


def subset_series(df: DataFrame, spec: AnalysisSpec, top: Union[DataFrame, Mapping[str, str]],
                  wanted: Sequence[int] | None = None) -> DataFrame:
    """One row per (subset slice, period) with ``total_units`` and
    ``num_data_points``.

    ``top`` is the ``screening.top_values`` DataFrame (variable, value; at
    most one row per test column, by construction) or an already collected
    mapping test column -> top value (as string).  A column without a top
    value has no subsets.  ``wanted`` limits the work to the subsets with these
    ordinals.
    Output columns: the time column; each test column holding the top value
    when the subset contains it and NULL when rolled up ("All"); the
    description column of each described test column (the smallest one of
    the code in the whole table, NULL when rolled up);
    ``n_keys`` (subset size), ``slice_ordinal`` (position of the subset in
    size-then-lexicographic order, 0 = all rows; int, or decimal beyond 31 test
    columns) and ``slice_key``.

    A row that holds the top value in b columns is in 2^b slices, so the result
    is bounded by what rows have in common, not by 2^k.
    """
    t = spec.time_col
    tests = list(spec.test_cols)
    k = len(tests)
    if not k:
        raise ValueError("the subset lattice needs at least one test column")
    if k > 126:
        raise ValueError("the subset lattice takes at most 126 test columns")
    described = [i for i, c in enumerate(tests) if c in spec.desc_cols]
    words = [f"_m{w}" for w in range(-(-k // _WORD))]
    texts = [f"_t{i}" for i in described]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    if isinstance(top, DataFrame):
        # <= k entries: one per test column (row_number = 1 per variable).
        topmap = top.agg(F.map_from_entries(F.collect_list(F.struct("variable", "value")))).scalar()
        src = df.select("*", topmap.alias("_topmap"))

        def val(c):
            return f"try_element_at(_topmap, {slit(c)})"
    else:
        src = df

        def val(c):
            return slit(top[c]) if top.get(c) is not None else "CAST(NULL AS STRING)"

    def match(i):
        """In the column's own type, so that nothing is cast per row."""
        return f"coalesce({q(tests[i])} = CAST({val(tests[i])} AS {types[tests[i]]}), false)"

    def mask(w):
        own = range(w * _WORD, min(k, (w + 1) * _WORD))
        return " | ".join(f"IF({match(i)}, {1 << (i - w * _WORD)}L, 0L)" for i in own)

    m = Measure(df, spec)
    # The descriptions of the held values are grouped by too (one each, as a
    # rule), so that the smallest one comes from this result, not from another scan
    pre = m.split(src, q(t), *[f"{mask(w)} AS {c}" for w, c in enumerate(words)],
                  *[f"CASE WHEN {match(i)} THEN CAST({q(spec.desc_cols[tests[i]])} AS STRING) END AS _t{i}" for i in described]) \
        .groupBy(t, *words, *texts, *m.keys).agg(*m.add())

    chosen = None if wanted is None else [spec.subset_at(j) for j in wanted]
    if chosen == []:
        raise ValueError("wanted names no subset")
    rolled = pre
    for w, word in enumerate(words):
        held = min(k - w * _WORD, _WORD)  # bits of this word
        for low in range(0, held, _PASS):
            high = min(low + _PASS, held) - 1
            bits = (1 << high + 1) - (1 << low)
            subsets = (f"aggregate(sequence({low}, {high}), array({word} & {~bits}L), (acc, i) -> "
                       f"IF((shiftright({word}, i) & 1) = 1, concat(acc, transform(acc, x -> x | shiftleft(1L, i))), acc))")
            if chosen is not None:
                parts = {_word(s, w) & bits for s in chosen}
                subsets = f"filter({subsets}, x -> (x & {bits}L) IN ({', '.join(f'{p}L' for p in sorted(parts))}))"
            others = [q(c) for c in (t, *words, *m.keys) if c != word]
            rolled = rolled.selectExpr(*others, *m.sums, "num_data_points", f"explode({subsets}) AS {word}") \
                .groupBy(t, *words, *m.keys).agg(*m.add("num_data_points"))
    if chosen is not None:
        exact = [" AND ".join(f"{c} = {_word(s, w)}L" for w, c in enumerate(words)) for s in chosen]
        rolled = rolled.where(" OR ".join(f"({e})" for e in exact))
    rolled = m.total(rolled, t, *words)
    if isinstance(top, DataFrame):
        rolled = rolled.select("*", topmap.alias("_topmap"))

    def inside(i):
        return f"(shiftright({words[i // _WORD]}, {i % _WORD}) & 1) = 1"

    if described:  # a global aggregate of the small result, one row that joins as a scalar
        one = pre.agg(F.struct(*[F.min(c).alias(c) for c in texts])).scalar()
        rolled = rolled.select("*", one.alias("_desc"))
    out = rolled.selectExpr(
        q(t),
        *[f"CAST(CASE WHEN {inside(i)} THEN {val(c)} END AS {types[c]}) AS {q(c)}" for i, c in enumerate(tests)],
        *[f"CASE WHEN {inside(i)} THEN _desc._t{i} END AS {q(spec.desc_cols[tests[i]])}" for i in described],
        f"{_size_sql(words)} AS n_keys", f"{_ordinal_sql(words, k)} AS slice_ordinal",
        "total_units", "num_data_points")
    return out.selectExpr("*", f"{slice_label_sql(tests)} AS slice_key")


def slice_columns(spec: AnalysisSpec) -> list[str]:
    """Columns that are constant within one lattice slice."""
    return (list(spec.test_cols) + [spec.desc_cols[c] for c in spec.test_cols if c in spec.desc_cols]
            + ["n_keys", "slice_ordinal", "slice_key"])
