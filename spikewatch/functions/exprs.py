"""Column expressions shared by the operators.

Every helper builds one Spark SQL expression: ``*_sql`` functions return the
SQL text, the others wrap it in ``F.expr``.  Catalyst sees the same expression
tree either way, and all of it is built-in, so it stays inside whole-stage
codegen (nothing here runs Python per row).  Writing the larger expressions
as SQL text also keeps plan construction to one driver-to-JVM call per
column instead of one per operator node.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import RULE_COUNT, RULE_JUMP, RULE_SHIFT, RULE_Z


def q(name: str) -> str:
    """Back-quoted column name."""
    return "`" + name.replace("`", "``") + "`"


def dlit(x: float) -> str:
    """A double literal in SQL text (plain ``0.33`` would be a decimal)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def slit(s: str) -> str:
    """A string literal in SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def all_of_sql(conds: Iterable[str]) -> Optional[str]:
    conds = [f"({c})" for c in conds]
    return " AND ".join(conds) if conds else None


def any_of_sql(conds: Iterable[str]) -> Optional[str]:
    """Three-valued OR of the given flags (NULL OR false = NULL)."""
    conds = [f"({c})" for c in conds]
    return " OR ".join(conds) if conds else None


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def metric_units_sql(metric: str, scale: Optional[int], dtype: str = "double") -> str:
    """The metric as it is summed.

    ``scale=None``: as given.  Integers and decimals are summed as decimals,
    exactly; every other type as doubles, so NaN and infinity propagate.

    A ``scale`` is an opt-in to exact integer units of ``10 ** -scale`` (cents
    for scale 2), whose sums do not depend on the order of the rows.  A value
    that is no whole number of units (or NaN, infinite, or too large to be
    exact) fails the job instead of being rounded.
    """
    if scale is None:
        if dtype in _INTEGRAL:
            return f"CAST({metric} AS DECIMAL(38,0))"
        return metric if dtype.startswith("decimal") else f"CAST({metric} AS DOUBLE)"
    if dtype in _INTEGRAL or dtype.startswith("decimal"):
        units = f"CAST({metric} AS DECIMAL(38,{scale}))"
        whole = f"CAST({units} * {10 ** scale} AS BIGINT)"
        return f"CASE WHEN {metric} IS NULL THEN NULL WHEN {units} = {metric} THEN {whole} ELSE {_not_whole(metric, scale)} END"
    x, s = f"CAST({metric} AS DOUBLE)", dlit(10 ** scale)
    units = f"FLOOR({x} * {s} + {dlit(0.5)})"
    exact = f"abs({x}) < {dlit(2 ** 53 / 10 ** scale)} AND CAST({units} AS DOUBLE) / {s} = {x}"
    return f"CASE WHEN {metric} IS NULL THEN NULL WHEN {exact} THEN {units} ELSE {_not_whole(metric, scale)} END"


def _not_whole(metric: str, scale: int) -> str:
    return f"CAST(raise_error(concat('metric value ', CAST({metric} AS STRING), ' is no exact multiple of 1e-{scale}')) AS BIGINT)"


def metric_units(metric: str, scale: Optional[int], dtype: str = "double") -> Column:
    """``metric_units_sql`` for a column name."""
    return F.expr(metric_units_sql(q(metric), scale, dtype))


def units_to_value_sql(units: str, scale: Optional[int]) -> str:
    if scale is None:
        return f"CAST({units} AS DOUBLE)"
    return f"CAST({units} AS DOUBLE) / {dlit(10 ** scale)}"


# -- exact %.Nf text ---------------------------------------------------------
# Python rounds the exact binary value half-to-even; Java's formatter (so
# ``format_string``) rounds the shortest decimal form half-up, which differs
# for values such as 2.675 or 0.125.  ``x * 10^d`` is split exactly into
# ``p + e`` with Dekker's two-product (Veltkamp split of |x| into 26-bit
# halves; 10^d has at most 20 significant bits, so every partial product is
# exact) and rounded half-to-even on that exact sum.

def _parts_sql(x: str, digits: int) -> tuple[str, str]:
    s = dlit(10 ** digits)
    ax = f"ABS({x})"
    c = f"({ax} * {dlit(134217729.0)})"  # 2^27 + 1
    hi = f"({c} - ({c} - {ax}))"
    lo = f"({ax} - {hi})"
    p = f"({ax} * {s})"
    e = f"(({hi} * {s} - {p}) + {lo} * {s})"
    return p, e


def _round_sql(p: str, e: str) -> str:
    """Half-to-even rounding of the exact value ``p + e`` (p >= 0)."""
    f = f"FLOOR({p})"
    d = f"(({p} - {f}) - {dlit(0.5)})"
    up = f"(({d} > -({e})) OR ({d} = -({e}) AND pmod({f}, 2) = 1))"
    return f"({f} + CASE WHEN {up} THEN 1 ELSE 0 END)"


def _digits_sql(n: str, x: str, digits: int, prefix: str = "") -> str:
    s = f"CAST({n} AS STRING)"
    if digits:
        s = f"CASE WHEN length({s}) <= {digits} THEN lpad({s}, {digits + 1}, '0') ELSE {s} END"
        s = f"regexp_replace({s}, '([0-9]{{{digits}}})$', '.$1')"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE "
            f"concat({slit(prefix)}, CASE WHEN {x} < 0 OR ({x} = 0 AND CAST({x} AS STRING) LIKE '-%') "
            f"THEN '-' ELSE '' END, {s}) END")  # negative zero prints as -0.00


def _check_digits(digits: int) -> None:
    if not 0 <= digits <= 6:
        raise ValueError("digits must be within 0..6")


def fixed_text_sql(x: str, digits: int = 2, prefix: str = "") -> str:
    """``prefix + '%.{digits}f' % x`` as one SQL expression over the SQL text
    ``x``; prefer ``add_fixed_text`` for several values (it rounds each value
    once and keeps the generated code small)."""
    _check_digits(digits)
    v = f"CAST({x} AS DOUBLE)"
    p, e = _parts_sql(v, digits)
    return _digits_sql(_round_sql(p, e), v, digits, prefix)


def fixed_text(name: str, digits: int = 2) -> Column:
    """``'%.{digits}f' % x`` of column ``name``, exactly as Python (and
    DuckDB's printf) print it."""
    return F.expr(fixed_text_sql(q(name), digits))


def money_text(name: str) -> Column:
    """``f"${x:.2f}"`` of column ``name``."""
    return F.expr(fixed_text_sql(q(name), 2, "$"))


def add_fixed_text(df: DataFrame, cols: Mapping[str, str], digits: int = 2,
                   prefix: Union[str, Mapping[str, str]] = "") -> DataFrame:
    """Add ``prefix + '%.{digits}f' % x`` text columns for each
    ``name -> x`` (``x``: SQL expression text), printed exactly as Python and
    DuckDB's printf print them.  Staged over three projections so every
    value is rounded once and the generated code stays small."""
    _check_digits(digits)
    names = list(cols)
    tmp = lambda i, part: f"__fx{i}_{part}"
    stage1 = []
    for i, n in enumerate(names):
        x = f"CAST({cols[n]} AS DOUBLE)"
        p, e = _parts_sql(x, digits)
        stage1 += [f"{x} AS {tmp(i, 'x')}", f"{p} AS {tmp(i, 'p')}", f"{e} AS {tmp(i, 'e')}"]
    df = df.selectExpr("*", *stage1)
    df = df.selectExpr("*", *[f"{_round_sql(tmp(i, 'p'), tmp(i, 'e'))} AS {tmp(i, 'n')}"
                              for i, _ in enumerate(names)])
    keep = [q(c) for c in df.columns if not c.startswith("__fx") and c not in cols]
    out = []
    for i, n in enumerate(names):
        pre = prefix if isinstance(prefix, str) else prefix.get(n, "")
        out.append(f"{_digits_sql(tmp(i, 'n'), tmp(i, 'x'), digits, pre)} AS {q(n)}")
    return df.selectExpr(*keep, *out)


def underline_sql(line: str, char: str = "-") -> str:
    return f"repeat({slit(char)}, length({line}))"


def rule_names_sql(z: Optional[str], jump: Optional[str], shift: Optional[str],
                   count: Optional[str] = None) -> str:
    """Names of the rules that fired, in the fixed order z, metric, change,
    count (array<string>, empty when none fired); arguments are flag column
    names or None."""
    parts = [f"CASE WHEN {q(flag)} THEN {slit(name)} END" for flag, name in
             ((z, RULE_Z), (jump, RULE_JUMP), (shift, RULE_SHIFT), (count, RULE_COUNT))
             if flag is not None]
    return f"array_compact(array({', '.join(parts)}))" if parts else "CAST(array() AS ARRAY<STRING>)"


def rule_names(z: Optional[str], jump: Optional[str], shift: Optional[str],
               count: Optional[str] = None) -> Column:
    return F.expr(rule_names_sql(z, jump, shift, count))


def slice_label_sql(test_cols: Sequence[str]) -> str:
    """Slice key: a JSON object of the non-NULL slice columns in spec order
    (no two slices share a key, whatever their values hold); ``all`` for the
    unsliced series."""
    if not test_cols:
        return "'all'"
    parts = ", ".join(f"CAST({q(c)} AS STRING) AS {q(c)}" for c in test_cols)
    return f"coalesce(nullif(to_json(struct({parts})), '{{}}'), 'all')"


def slice_label(test_cols: Sequence[str]) -> Column:
    return F.expr(slice_label_sql(test_cols))


def series_name(test_cols: Sequence[str]) -> Column:
    """File-style series name: ``outliers_all`` or ``outliers_<var>_<value>...``."""
    if not test_cols:
        return F.lit("outliers_all")
    parts = ", ".join(f"concat({slit(c + '_')}, CAST({q(c)} AS STRING))" for c in test_cols)
    return F.expr(f"concat('outliers_', coalesce(nullif(concat_ws('_', {parts}), ''), 'all'))")


# Point classes, legend labels and colours of the anomaly chart.
POINT_COLORS = {"z_score": "red", "metric": "green", "change": "blue", "multiple": "purple"}
POINT_LABELS = {"z_score": "Z score Outliers", "metric": "Metric Outliers",
                "change": "Change Point", "multiple": "Multiple Outliers"}


# The same for the exploratory (EDA) chart.
EDA_POINT_COLORS = {"z_score": "red", "count": "blue", "metric": "green", "multiple": "purple"}
EDA_POINT_LABELS = {"z_score": "Z-Score Outliers", "count": "Count-Based Outliers",
                    "metric": "Metric-Based Outliers", "multiple": "Multiple Outlier Conditions"}


def point_class_sql(types: str) -> str:
    """One fired rule -> its name; more than one -> ``multiple``."""
    return f"CASE WHEN size({types}) > 1 THEN 'multiple' ELSE element_at({types}, 1) END"


def _lookup_sql(mapping: dict, key: str) -> str:
    arms = " ".join(f"WHEN {slit(k)} THEN {slit(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} END"


def point_label_sql(cls: str, labels: Mapping[str, str] = POINT_LABELS) -> str:
    return _lookup_sql(labels, cls)


def point_color_sql(cls: str, colors: Mapping[str, str] = POINT_COLORS) -> str:
    return _lookup_sql(colors, cls)
