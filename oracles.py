"""DuckDB SQL oracles for the registered queries.

Each builder returns plain ANSI-ish SQL that DuckDB runs on the driver's
parquet views.  The oracles restate the semantics directly (one filter and
aggregate per subset, explicit window frames), independently of how the
Spark plans compute them, so a match checks the Spark plan, not a copy of it.
Numbers are produced with the same IEEE operations in the same order as the
Spark side (exact integer cents, then one division / square root per value),
so results agree bit for bit.
"""

from __future__ import annotations

from typing import Sequence

from spikewatch.spec import RuleSet


def units(metric: str, scale: int = 2) -> str:
    return f"CAST(CAST({metric} AS DECIMAL(18,{scale})) * {10 ** scale} AS BIGINT)"


def to_value(u: str, scale: int = 2) -> str:
    return f"(CAST({u} AS DOUBLE) / {float(10 ** scale)!r})"


def _exact_double(h: str) -> str:
    """Correctly rounded HUGEINT -> DOUBLE for 0 <= h < 2^85 (two exact parts,
    one rounding), matching Java's BigDecimal.doubleValue."""
    return (f"(CAST(({h}) // 4294967296 AS DOUBLE) * 4294967296.0 "
            f"+ CAST(({h}) % 4294967296 AS DOUBLE))")


def signed_double(h: str) -> str:
    """Correctly rounded HUGEINT -> DOUBLE of either sign: the 60 bits from the
    highest one down, a last bit for what lies below them, one rounding."""
    wide = (f"[CAST(((abs(v) >> s) | CASE WHEN abs(v) & ((CAST(1 AS HUGEINT) << s) - 1) = 0 THEN 0 ELSE 1 END) AS DOUBLE) * pow(2.0, s) "
            f"for s in [greatest(CAST(ceil(log2(CAST(abs(v) AS DOUBLE))) AS INTEGER) - 60, 1)]][1]")
    return f"[CASE WHEN abs(v) < 1152921504606846976 THEN CAST(v AS DOUBLE) ELSE sign(v) * {wide} END for v in [{h}]][1]"


def series_sql(src: str, t: str, metric: str, keys: Sequence[str] = (), where: str = "",
               carry: Sequence[str] = (), scale: int = 2) -> str:
    """Per (keys, period) totals: columns keys, carry, t, tu (BIGINT units),
    n (row count).  ``carry`` columns are constant per key."""
    grp = ", ".join([*keys, *carry, t])
    sel = ", ".join([*keys, *carry, t])
    w = f" WHERE {where}" if where else ""
    return (f"SELECT {sel}, CAST(SUM({units(metric, scale)}) AS BIGINT) AS tu, COUNT(*) AS n "
            f"FROM {src}{w} GROUP BY {grp}")


def rolled_sql(series: str, t: str, rules: RuleSet, keys: Sequence[str] = (),
               carry: Sequence[str] = (), scale: int = 2) -> str:
    """W1-W6 over a series SELECT (columns keys, carry, t, tu, n)."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    order = f"{part}ORDER BY {t}"

    def frame(lo: int, hi: int) -> str:
        def b(v):
            if v < 0:
                return f"{-v} PRECEDING"
            if v > 0:
                return f"{v} FOLLOWING"
            return "CURRENT ROW"
        return f"OVER ({order} ROWS BETWEEN {b(lo)} AND {b(hi)})"

    h, k = rules.half_window, rules.shift_span
    sf = float(10 ** scale)
    cols = [
        *keys, *carry, t,
        f"{to_value('tu', scale)} AS total_metric",
        "n AS num_data_points",
        f"{to_value(f'LAG(tu) OVER ({order})', scale)} AS prev_total_metric",
        f"LAG(n) OVER ({order}) AS prev_num_data_points",
        f"COUNT(tu) {frame(-h, h)} AS _c",
        f"SUM(tu) {frame(-h, h)} AS _s1",
        f"SUM(CAST(tu AS HUGEINT) * CAST(tu AS HUGEINT)) {frame(-h, h)} AS _s2",
    ]
    if rules.shift_enabled:
        cols += [f"COUNT(tu) {frame(-k, -1)} AS _pc", f"SUM(tu) {frame(-k, -1)} AS _ps",
                 f"COUNT(tu) {frame(1, k)} AS _nc", f"SUM(tu) {frame(1, k)} AS _ns"]
    inner = f"SELECT {', '.join(cols)} FROM ({series}) _s"
    num = "(CAST(_c AS HUGEINT) * _s2 - CAST(_s1 AS HUGEINT) * CAST(_s1 AS HUGEINT))"
    outs = [
        *keys, *carry, t, "total_metric", "num_data_points", "prev_total_metric", "prev_num_data_points",
        f"CASE WHEN _c > 0 THEN CAST(_s1 AS DOUBLE) / CAST(_c AS DOUBLE) / {sf!r} END AS rolling_mean",
        f"CASE WHEN _c > 1 THEN SQRT({_exact_double(num)} / (CAST(_c AS DOUBLE) * CAST(_c - 1 AS DOUBLE)))"
        f" / {sf!r} END AS rolling_std",
    ]
    if rules.shift_enabled:
        outs += [f"CASE WHEN _pc > 0 THEN CAST(_ps AS DOUBLE) / CAST(_pc AS DOUBLE) / {sf!r} END AS mean_prev",
                 f"CASE WHEN _nc > 0 THEN CAST(_ns AS DOUBLE) / CAST(_nc AS DOUBLE) / {sf!r} END AS mean_next"]
    return f"SELECT {', '.join(outs)} FROM ({inner}) _w"


def detect_sql(series: str, t: str, rules: RuleSet, keys: Sequence[str] = (),
               carry: Sequence[str] = (), scale: int = 2) -> str:
    """D1-D8 over ``rolled_sql``; same columns as ``spikewatch.operators.detect``."""
    rolled = rolled_sql(series, t, rules, keys, carry, scale)
    x = "total_metric"
    prev = "COALESCE(prev_total_metric, total_metric)" if rules.backfill_first else "prev_total_metric"
    prevn = ("COALESCE(prev_num_data_points, num_data_points)" if rules.backfill_first
             else "prev_num_data_points")
    std_raw = "rolling_std"
    guarded = "CASE WHEN rolling_mean = 0 THEN 0.0 ELSE rolling_std END"
    std_z = guarded if rules.zero_mean_guard == "before_z" else std_raw
    std_out = std_raw if rules.zero_mean_guard == "none" else guarded
    z = f"CASE WHEN ({std_z}) = 0 THEN 0.0 ELSE ABS(({x} - rolling_mean) / ({std_z})) END"
    base = [*keys, *carry, t, x, "num_data_points", f"{prev} AS prev_total_metric",
            f"{prevn} AS prev_num_data_points", "rolling_mean", f"{std_out} AS rolling_std"]
    if rules.shift_enabled:
        base += ["mean_prev", "mean_next"]
    base.append(f"{z} AS z_score")
    stage = f"SELECT {', '.join(base)} FROM ({rolled}) _r"

    flags = []
    if rules.z_cut is not None:
        flags.append(f"CASE WHEN rolling_std = 0 THEN false ELSE z_score > {float(rules.z_cut)!r} END"
                     " AS is_outlier_z")
    if rules.jump_enabled:
        ratio = f"(total_metric >= {float(rules.jump_up)!r} * prev_total_metric"
        if rules.jump_down is not None:
            ratio += f" OR total_metric <= {float(rules.jump_down)!r} * prev_total_metric"
        ratio += ")"
        flags.append(f"({ratio} AND ABS(total_metric - prev_total_metric) > {float(rules.jump_min_abs)!r})"
                     " AS is_outlier_metric")
    if rules.shift_enabled:
        r = float(rules.shift_ratio)
        flags.append(f"((mean_next >= {r!r} * mean_prev OR mean_prev >= {r!r} * mean_next)"
                     f" AND ABS(mean_next - mean_prev) > {float(rules.shift_min_abs)!r}"
                     " AND mean_prev IS NOT NULL AND mean_next IS NOT NULL) AS change_point")
    if rules.count_enabled:
        r = float(rules.count_ratio)
        flags.append(f"((num_data_points >= {r!r} * prev_num_data_points"
                     f" OR num_data_points <= prev_num_data_points / {r!r})"
                     f" AND GREATEST(num_data_points, prev_num_data_points) > {float(rules.count_min)!r})"
                     " AS is_outlier_count")
    flagged = f"SELECT *, {', '.join(flags)} FROM ({stage}) _z"
    names = [f.rsplit(" AS ", 1)[1] for f in flags]
    order = [c for c in ("is_outlier_z", "change_point", "is_outlier_metric", "is_outlier_count") if c in names]
    return f"SELECT *, ({' OR '.join(order)}) AS is_outlier FROM ({flagged}) _f"


def rule_names_sql() -> str:
    return ("concat_ws(',', CASE WHEN is_outlier_z THEN 'z_score' END, "
            "CASE WHEN is_outlier_metric THEN 'metric' END, CASE WHEN change_point THEN 'change' END)")


def money(x: str) -> str:
    return f"('$' || printf('%.2f', {x}))"
