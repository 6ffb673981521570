"""Text report (R2, R3, X7-X9) as a DataFrame of lines.

Every selected finding becomes one block of lines built with string
expressions; the header comes from a one-row aggregate of the findings.  The
result has columns ``report_rank`` (0 = header), ``line_no`` and ``value``;
ordering by (report_rank, line_no) gives the report, which ``sinks.write_report``
writes as a single text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_fixed_text, q, slit, underline_sql
from ..operators.attribute import ranked_findings
from ..spec import RULE_JUMP, RULE_SHIFT, RULE_Z, AnalysisSpec, RuleSet

# Header of the report.
# The rules and section texts of the report.
HEADER_RULE = "=" * 50
BLOCK_RULE = "=" * 40


def header_lines(z_cut: float, half_window: int = 3) -> list[str]:
    z_text = ("%g" % z_cut) if z_cut is not None else "n/a"
    return [
        "ANOMALY REPORT SUMMARY",
        HEADER_RULE,
        "This report sums up total costs by week.",
        "",
        "Anomaly Types:",
        "  - Metric Anomaly: The week's total cost doubled or halved from the previous week.",
        "  - Z-Score Anomaly: The total cost for the week was over or under the rolling mean "
        f"(over {2 * half_window + 1} time periods) by more than {z_text} standard deviations.",
        "  - Change Points: Significant change in data (the mean double/halved over a month)",
        HEADER_RULE,
    ]


def grouping_sql(spec: AnalysisSpec) -> str:
    """``Grouping: d1, d2, ...``: per test column the description of the
    slice's value, ``All`` when the column is rolled up.  Without a
    description column the value itself is shown."""
    parts = []
    for c in spec.test_cols:
        shown = (f"coalesce(CAST({q(spec.desc_cols[c])} AS STRING), 'None')" if c in spec.desc_cols
                 else f"CAST({q(c)} AS STRING)")
        parts.append(f"CASE WHEN {q(c)} IS NULL THEN 'All' ELSE {shown} END")
    return f"concat('Grouping: ', concat_ws(', ', {', '.join(parts)}))"


def grouping_text(spec: AnalysisSpec) -> Column:
    return F.expr(grouping_sql(spec))


# Numbers printed in the report, as ``$%.2f`` (money) or ``%.2f`` (z).
_MONEY = ("total_metric", "prev_total_metric", "mean_prev", "mean_next", "rolling_mean", "rolling_std")


def with_figures(ranked: DataFrame) -> DataFrame:
    """Adds the printed figures as text columns ``_t_<name>`` (staged, so every
    number is rounded once) and the signed z-score text ``_t_z`` (R3)."""
    figs = {f"_t_{c}": c for c in _MONEY if c in ranked.columns}
    figs["_t_z"] = "CASE WHEN rolling_std != 0 THEN (total_metric - rolling_mean) / rolling_std END"
    prefixes = {n: ("" if n == "_t_z" else "$") for n in figs}
    return add_fixed_text(ranked, figs, 2, prefix=prefixes)


def _arr(*items: str) -> str:
    return f"array({', '.join(items)})"


def block_lines_sql(spec: AnalysisSpec) -> str:
    """The lines of one report block, sections in the order metric, change, z
    (expects the columns of ``with_figures`` and ``_grouping``)."""
    noun = spec.noun
    x = "_t_total_metric"
    empty = "CAST(array() AS ARRAY<STRING>)"
    metric = _arr("'Metric Anomaly:'", f"concat('  - Total Cost: ', {x})",
                  "concat('  - Previous Week Cost: ', _t_prev_total_metric)")
    change = _arr("'Change Point:'", f"concat('  - Total Cost: ', {x})",
                  f"concat({slit(f'  - Previous Two {noun} Average Cost: ')}, _t_mean_prev)",
                  f"concat({slit(f'  - Next Two {noun} Average Cost: ')}, _t_mean_next)")
    zsec = _arr("'Z-Score Anomaly:'", f"concat('  - Total Cost: ', {x})",
                "concat('  - Rolling Mean: ', _t_rolling_mean)",
                "concat('  - Standard Deviation: ', _t_rolling_std)",
                "concat('  - Z-Score: ', _t_z)")

    def section(rule, lines):
        return f"CASE WHEN array_contains(anomaly_types, {slit(rule)}) THEN {lines} ELSE {empty} END"

    head = _arr(f"concat('Week: ', CAST({q(spec.time_col)} AS STRING))", slit(BLOCK_RULE),
                "_grouping", underline_sql("_grouping"))
    # one more blank line before the first block (the header ends with one);
    # four blank lines between blocks, three after the last one
    leading = f"CASE WHEN report_rank = 1 THEN array('') ELSE {empty} END"
    trailing = "array_repeat('', CASE WHEN report_rank = n_blocks THEN 3 ELSE 4 END)"
    return (f"concat({leading}, {head}, {section(RULE_JUMP, metric)}, {section(RULE_SHIFT, change)}, "
            f"{section(RULE_Z, zsec)}, {trailing})")


def report_lines(selected: DataFrame, spec: AnalysisSpec, rules: RuleSet) -> DataFrame:
    """R2: ``selected`` is the most-specific finding per period (``most_specific``)."""
    ranked = with_figures(ranked_findings(selected, spec))
    extra = [f"CAST(NULL AS STRING) AS _t_{c}" for c in _MONEY if f"_t_{c}" not in ranked.columns]
    blocks = ranked.selectExpr("*", *extra, f"{grouping_sql(spec)} AS _grouping").selectExpr(
        "report_rank", f"posexplode({block_lines_sql(spec)}) AS (line_no, value)")
    # The header is fixed text (a one-row leaf, not a second pass over the
    # findings): its lines and one blank line.
    header = ", ".join(slit(s) for s in header_lines(rules.z_cut, rules.half_window) + [""])
    head = selected.sparkSession.range(1).selectExpr(
        "0 AS report_rank", f"posexplode(array({header})) AS (line_no, value)")
    return head.unionByName(blocks)
