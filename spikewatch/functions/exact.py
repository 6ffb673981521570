"""Sums of doubles that no row order changes, in built-in functions.

A double is split into whole numbers at fixed places: its exponent names a bin
of 28 bits, and its 53 bits are at most three digits of that size from there
down.  Digits are summed as integers, per bin, so partial sums may meet in any
order.  The bins of a group are then carried into one long number, which is
rounded once: the result is the exact sum's nearest double.
"""

from __future__ import annotations

from .exprs import dlit

WIDTH = 28
BASE = 1 << WIDTH
#: Bins of the smallest and the largest double, with room for carries and for digits below.
LOWEST, HIGHEST = -46, 44


def _powers(exponents) -> str:
    return f"array({', '.join(dlit(2.0 ** e) for e in exponents)})"


def _scaled(x: str, place: str, sign: int, shift: int = 0) -> str:
    """``x`` times 2 ^ (``sign`` * WIDTH * ``place`` + ``shift``), in two exact steps."""
    whole = [sign * WIDTH * p + shift for p in range(LOWEST, HIGHEST + 1)]
    near = [max(-1000, min(1000, e)) for e in whole]
    at = f"CAST({place} - ({LOWEST}) + 1 AS INT)"
    rest = _powers(max(-1000, min(1000, w - n)) for w, n in zip(whole, near))
    return f"{x} * element_at({_powers(near)}, {at}) * element_at({rest}, {at})"


#: Additive columns of a double ``_x``: its digits and what is not finite.
SUMS = ("_d2", "_d1", "_d0", "_odd")
BIN = "_bin"


def split_stages(x: str) -> list[list[str]]:
    """Projections, one after the other, that add ``_bin`` and the ``SUMS`` of
    the double ``x`` (SQL text): each a list of expressions beside ``*``."""
    finite = f"abs(_x) < {dlit(float('inf'))}"  # false for NaN
    return [
        [f"CAST({x} AS DOUBLE) AS _x"],
        [f"CASE WHEN _x != 0 AND {finite} THEN CAST(floor(log2(abs(_x)) / {WIDTH}) AS INT) END AS {BIN}",
         f"CASE WHEN _x IS NOT NULL AND NOT coalesce({finite}, false) THEN _x END AS _odd"],
        [f"CASE WHEN {BIN} IS NOT NULL THEN {_scaled('_x', BIN, -1)} WHEN _x IS NOT NULL THEN {dlit(0)} END AS _y2"],
        ["CAST(_y2 AS BIGINT) AS _d2", f"(_y2 - CAST(CAST(_y2 AS BIGINT) AS DOUBLE)) * {dlit(BASE)} AS _y1"],
        ["CAST(_y1 AS BIGINT) AS _d1", f"CAST((_y1 - CAST(CAST(_y1 AS BIGINT) AS DOUBLE)) * {dlit(BASE)} AS BIGINT) AS _d0"],
    ]


def join_stages(bins: str, odd: str, name: str) -> list[list[str]]:
    """Projections that make ``name``, the exact sum rounded once, of ``bins``
    (an array of structs of ``_bin`` and the digits' sums) and ``odd``."""
    wide = "DECIMAL(38,0)"
    digits = f"filter({bins}, e -> e._bin IS NOT NULL)"

    def at(p: str) -> str:
        """The digit sums of place ``p``."""
        own = " + ".join(f"CASE WHEN e._bin = {p} + {k} THEN CAST(e._d{2 - k} AS {wide}) ELSE 0 END" for k in range(3))
        return f"aggregate(_bins, CAST(0 AS {wide}), (a, e) -> CAST(a + {own} AS {wide}))"

    # the lowest place first: a digit below BASE stays, the rest is carried
    carried = ("aggregate(_places, named_struct('digits', CAST(array() AS ARRAY<BIGINT>), 'carry', CAST(0 AS " + wide + ")), (a, v) -> "
               f"named_struct('digits', concat(a.digits, array(CAST(pmod(v + a.carry, {BASE}) AS BIGINT))), 'carry', "
               f"CAST(((v + a.carry) - pmod(v + a.carry, {BASE})) div {BASE} AS {wide})))")
    # the four digits from the top one down, doubled, and a last bit for what lies below them
    top = (f"aggregate(reverse(slice(_number, _top - 3, 4)), CAST(0 AS {wide}), (a, d) -> CAST(a * {BASE} + d AS {wide}))")
    below = "CASE WHEN exists(slice(_number, 1, greatest(_top - 4, 0)), d -> d != 0) THEN 1 ELSE 0 END"
    return [
        [f"{digits} AS _bins"],
        ["CASE WHEN size(_bins) > 0 THEN transform(sequence(array_min(transform(_bins, e -> e._bin)) - 2, "
         f"array_max(transform(_bins, e -> e._bin)) + 1), p -> {at('p')}) ELSE CAST(array() AS ARRAY<{wide}>) END AS _places",
         "array_min(transform(_bins, e -> e._bin)) - 2 AS _low"],
        [f"{carried}.carry < 0 AS _minus"],
        ["transform(_places, v -> CAST(CASE WHEN _minus THEN -v ELSE v END AS " + wide + ")) AS _places"],
        # three zeros below, so that the four digits from the top down are always there
        [f"{carried} AS _sum"],
        ["concat(array(0L, 0L, 0L), _sum.digits, array(CAST(_sum.carry AS BIGINT))) AS _number"],
        ["aggregate(sequence(1, size(_number)), 0, (a, i) -> CASE WHEN element_at(_number, i) != 0 THEN i ELSE a END) AS _top"],
        [f"CASE WHEN _top > 0 THEN CAST(2 * {top} + {below} AS {wide}) END AS _rounded"],
        [f"CASE WHEN {odd} IS NOT NULL THEN {odd} WHEN size({bins}) = 0 OR NOT exists({bins}, e -> e._d2 IS NOT NULL) THEN NULL "
         f"WHEN _top = 0 OR _top IS NULL THEN {dlit(0)} ELSE CASE WHEN _minus THEN -1 ELSE 1 END * "
         f"({_scaled('CAST(_rounded AS DOUBLE)', '(_low + _top - 7)', 1, -1)}) END AS {name}"],
    ]
