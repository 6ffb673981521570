"""Rolling-window statistics (W1-W6) and the anomaly rules.

``detect`` takes a series (one row per slice and period, see ``series.py``)
and adds lagged values, centred rolling mean / sample deviation, the means of
the previous and next periods, and one boolean column per rule.

All frames are ROWS frames ordered by the period, partitioned by the slice key
columns, so every slice is an independent window partition: slices run in
parallel and a partition holds at most one slice's periods.  All window
expressions share one partition/order spec and are computed in a single
``select`` -> one Window operator over one sort.

With an integer metric (``spec.metric_scale`` set) the frame moments are exact
integer sums (count, sum, sum of squares), so the mean and the deviation are
derived from exact numbers and do not depend on the order rows arrive in.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import any_of_sql, dlit, q, units_to_value_sql
from ..spec import GUARD_AFTER_Z, GUARD_BEFORE_Z, GUARD_NONE, AnalysisSpec, RuleSet
from .order import numbered

_BIG = "DECIMAL(38,0)"
#: Frames reaching further than this use running sums.
_NEIGHBOURS = 8


def _bound(v: int) -> str:
    if v < 0:
        return f"{-v} PRECEDING"
    if v > 0:
        return f"{v} FOLLOWING"
    return "CURRENT ROW"


def rolling_columns(series: DataFrame, spec: AnalysisSpec, rules: RuleSet,
                    key_cols: Sequence[str] = ()) -> DataFrame:
    """W1-W6 in one Window operator.  Adds ``total_metric``,
    ``prev_total_metric``, ``prev_num_data_points`` (raw lags), ``rolling_mean``,
    ``rolling_std`` (raw) and, when the shift rule is on, ``mean_prev`` /
    ``mean_next``.

    With an integer metric the frames are tiny (a few rows each side), so the
    window operator only fetches neighbours with ``lag`` / ``lead`` (constant
    work per row) and the frame sums run in a code-generated projection:
    ``ROWS BETWEEN a PRECEDING AND b FOLLOWING`` over a column equals the
    non-NULL values among its lags 1..a, the row and its leads 1..b -- the
    neighbours past a partition edge are NULL, just as they are outside the
    frame.  (Sliding frames would re-aggregate every frame row by row.)"""
    part = f"PARTITION BY {', '.join(q(k) for k in key_cols)} " if key_cols else ""
    order = f"{part}ORDER BY {q(spec.time_col)}"
    scale = spec.metric_scale
    u = "total_units"
    h = rules.half_window
    k = rules.shift_span if rules.shift_enabled else 0
    base = [f"{units_to_value_sql(u, scale)} AS total_metric",
            f"{units_to_value_sql(f'lag({u}) OVER ({order})', scale)} AS prev_total_metric",
            f"lag(num_data_points) OVER ({order}) AS prev_num_data_points"]
    replaced = {"total_metric", "prev_total_metric", "prev_num_data_points", "rolling_mean", "rolling_std",
                "mean_prev", "mean_next"}
    keep = [q(c) for c in series.columns if c not in replaced]

    if scale is None:  # as given: built-in frame aggregates over the totals as doubles
        u = f"CAST({u} AS DOUBLE)"

        def over(lo, hi):
            return f"OVER ({order} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"
        cols = base + [f"avg({u}) {over(-h, h)} AS rolling_mean",
                       f"stddev_samp({u}) {over(-h, h)} AS rolling_std"]
        if k:
            cols += [f"avg({u}) {over(-k, -1)} AS mean_prev", f"avg({u}) {over(1, k)} AS mean_next"]
        return series.selectExpr(*keep, *cols)

    reach = max(h, k)
    if reach > _NEIGHBOURS:
        return _from_running_sums(series, keep, base, part, order, rules, scale)
    nb = {j: f"_nb_m{-j}" if j < 0 else f"_nb_p{j}" for j in range(-reach, reach + 1) if j}
    nb[0] = u
    fetch = [f"lag({u}, {-j}) OVER ({order}) AS {nb[j]}" if j < 0 else f"lead({u}, {j}) OVER ({order}) AS {nb[j]}"
             for j in sorted(nb) if j]
    stage = series.selectExpr(*keep, *base, *fetch)
    sf = dlit(10 ** scale)

    def n_of(lo, hi):
        return " + ".join(f"CASE WHEN {nb[j]} IS NULL THEN 0 ELSE 1 END" for j in range(lo, hi + 1))

    def s1_of(lo, hi):
        return " + ".join(f"coalesce({nb[j]}, 0)" for j in range(lo, hi + 1))

    def mean(lo, hi):
        n, s1 = f"({n_of(lo, hi)})", f"({s1_of(lo, hi)})"
        return f"CASE WHEN {n} > 0 THEN CAST({s1} AS DOUBLE) / CAST({n} AS DOUBLE) / {sf} END"

    def std(lo, hi):
        """Sample standard deviation; NULL below two values.  With integer
        units n * sum(x^2) - sum(x)^2 is exact (and never negative)."""
        n = f"({n_of(lo, hi)})"
        s1 = f"CAST({s1_of(lo, hi)} AS {_BIG})"
        s2 = " + ".join(f"coalesce(CAST({nb[j]} AS {_BIG}) * CAST({nb[j]} AS {_BIG}), CAST(0 AS {_BIG}))"
                        for j in range(lo, hi + 1))
        num = f"(CAST({n} AS {_BIG}) * ({s2}) - {s1} * {s1})"
        var = f"CAST({num} AS DOUBLE) / (CAST({n} AS DOUBLE) * CAST({n} - 1 AS DOUBLE))"
        return f"CASE WHEN {n} > 1 THEN SQRT({var}) / {sf} END"

    cols = [f"{mean(-h, h)} AS rolling_mean", f"{std(-h, h)} AS rolling_std"]
    if k:
        cols += [f"{mean(-k, -1)} AS mean_prev", f"{mean(1, k)} AS mean_next"]
    helpers = [nb[j] for j in nb if j]
    out = stage.selectExpr("*", *cols)
    return out.drop(*helpers)


def _from_running_sums(series: DataFrame, keep: Sequence[str], base: Sequence[str], part: str, order: str,
                       rules: RuleSet, scale: int) -> DataFrame:
    """W3-W6 for wide frames: running counts, sums and sums of squares, exact, and
    every frame's moments as the difference of two of them, fetched with ``lag``
    and ``lead``.  Work per row and plan size are the same for any width; a sum
    of squares beyond 38 digits fails the job."""
    h, k = rules.half_window, rules.shift_span if rules.shift_enabled else 0
    u, sf = "total_units", dlit(10 ** scale)
    wide = f"CAST({u} AS {_BIG})"
    moments = {"n": ("count", u), "s1": ("sum", wide), "s2": ("sum", f"{wide} * {wide}")}
    run, whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    zero = {m: f"CAST(0 AS {'BIGINT' if m == 'n' else _BIG})" for m in moments}
    sums = [f"coalesce(CAST({f}({x}) OVER ({order} {frame}) AS {'BIGINT' if m == 'n' else _BIG}), {zero[m]}) AS _{at}_{m}"
            for m, (f, x) in moments.items() for at, frame in (("run", run), ("all", whole))]
    stage = series.selectExpr(*keep, *base, *sums)

    frames = {"_c": (-h, h), **({"_p": (-k, -1), "_f": (1, k)} if k else {})}
    fetch = []
    for name, (lo, hi) in frames.items():
        for m in moments if name == "_c" else ("n", "s1"):
            # up to the frame's last row: all of them past the end; up to the row before its first: none
            last = f"_run_{m}" if hi == 0 else (f"coalesce(lead(_run_{m}, {hi}) OVER ({order}), _all_{m})" if hi > 0
                                                else f"coalesce(lag(_run_{m}, {-hi}) OVER ({order}), {zero[m]})")
            first = f"_run_{m}" if lo == 1 else f"coalesce(lag(_run_{m}, {1 - lo}) OVER ({order}), {zero[m]})"
            fetch.append(f"{last} - {first} AS {name}_{m}")
    kept = [q(c) for c in stage.columns if not c.startswith(("_run_", "_all_"))]
    stage = stage.selectExpr(*kept, *fetch)

    def mean(f):
        return f"CASE WHEN {f}_n > 0 THEN CAST({f}_s1 AS DOUBLE) / CAST({f}_n AS DOUBLE) / {sf} END"

    spread = f"CAST(CAST(_c_n AS {_BIG}) * _c_s2 - _c_s1 * _c_s1 AS {_BIG})"
    std = (f"CASE WHEN _c_n > 1 THEN SQRT(CAST({spread} AS DOUBLE) / (CAST(_c_n AS DOUBLE) * CAST(_c_n - 1 AS DOUBLE))) / {sf} END")
    cols = [f"{mean('_c')} AS rolling_mean", f"{std} AS rolling_std"]
    if k:
        cols += [f"{mean('_p')} AS mean_prev", f"{mean('_f')} AS mean_next"]
    return stage.selectExpr(*kept, *cols)


def apply_rules(rolled: DataFrame, rules: RuleSet, drop: Sequence[str] = ()) -> DataFrame:
    """D1-D8 on the output of ``rolling_columns``, as one projection
    (``drop``: input columns to leave out)."""
    if rules.zero_mean_guard not in (GUARD_NONE, GUARD_BEFORE_Z, GUARD_AFTER_Z):
        raise ValueError(f"unknown zero_mean_guard {rules.zero_mean_guard!r}")
    x, mean, n = "total_metric", "rolling_mean", "num_data_points"
    guarded = f"(CASE WHEN {mean} = 0 THEN {dlit(0)} ELSE rolling_std END)"  # D8
    # First-row backfill
    prev = f"coalesce(prev_total_metric, {x})" if rules.backfill_first else "prev_total_metric"
    pn = f"coalesce(prev_num_data_points, {n})" if rules.backfill_first else "prev_num_data_points"
    std_z = guarded if rules.zero_mean_guard == GUARD_BEFORE_Z else "rolling_std"
    std = "rolling_std" if rules.zero_mean_guard == GUARD_NONE else guarded
    # Absolute z-score, 0 where the deviation is 0
    z = f"(CASE WHEN {std_z} = 0 THEN {dlit(0)} ELSE abs(({x} - {mean}) / {std_z}) END)"

    cols = {"prev_total_metric": prev, "prev_num_data_points": pn, "rolling_std": std, "z_score": z}
    flags = {}
    if rules.z_cut is not None:  # D2
        flags["is_outlier_z"] = f"CASE WHEN {std} = 0 THEN false ELSE {z} > {dlit(rules.z_cut)} END"
    if rules.jump_enabled:  # D3
        ratio = " OR ".join(f"{x} {op} {dlit(cut)} * {prev}" for op, cut in
                            ((">=", rules.jump_up), ("<=", rules.jump_down)) if cut is not None)
        flags["is_outlier_metric"] = f"({ratio}) AND abs({x} - {prev}) > {dlit(rules.jump_min_abs)}"
    if rules.shift_enabled:  # D4, never NULL
        r = dlit(rules.shift_ratio)
        flags["change_point"] = (
            f"(mean_next >= {r} * mean_prev OR mean_prev >= {r} * mean_next)"
            f" AND abs(mean_next - mean_prev) > {dlit(rules.shift_min_abs)}"
            " AND mean_prev IS NOT NULL AND mean_next IS NOT NULL")
    if rules.count_enabled:  # D5
        r = dlit(rules.count_ratio)
        flags["is_outlier_count"] = (
            f"({n} >= {r} * {pn} OR {n} <= {pn} / {r}) AND greatest({n}, {pn}) > {dlit(rules.count_min)}")
    # Three-valued OR of the enabled rules, in the reference order
    order = ["is_outlier_z", "change_point", "is_outlier_metric", "is_outlier_count"]
    anyflag = any_of_sql(flags[c] for c in order if c in flags)
    cols.update(flags)
    cols["is_outlier"] = anyflag if anyflag is not None else "CAST(NULL AS BOOLEAN)"
    keep = [q(c) for c in rolled.columns if c not in cols and c not in drop]
    return rolled.selectExpr(*keep, *[f"{e} AS {k}" for k, e in cols.items()])


def detect(series: DataFrame, spec: AnalysisSpec, rules: RuleSet,
           key_cols: Sequence[str] = (), block_rows: Optional[int] = None) -> DataFrame:
    """Windows + rules over a series with ``total_units`` and
    ``num_data_points``; ``key_cols`` identify the slice (window partition).

    ``block_rows`` switches to the blocked form for very long series (see
    ``blocked_detect``); the result is identical."""
    if block_rows is not None:
        return blocked_detect(series, spec, rules, key_cols, block_rows)
    return apply_rules(rolling_columns(series, spec, rules, key_cols), rules, drop=("total_units",))


def period_index(series: DataFrame, spec: AnalysisSpec, key_cols: Sequence[str] = (), ranges: Optional[int] = None) -> DataFrame:
    """Adds ``_i``: the 0-based place of each row in the order of slices, then
    time, numbered over range partitions (``order.numbered``), so that no task
    orders a whole slice and the time column may be of any type that sorts.
    Within a slice the places follow each other."""
    return numbered(series, [F.col(q(c)).asc_nulls_first() for c in (*key_cols, spec.time_col)], "_i", ranges=ranges)


def blocked_detect(series: DataFrame, spec: AnalysisSpec, rules: RuleSet,
                   key_cols: Sequence[str] = (), block_rows: int = 4096, ranges: Optional[int] = None) -> DataFrame:
    """``detect`` for series too long for one window task.

    Rows are numbered in the order of slices and time (``period_index``) and cut
    into blocks of ``block_rows``; every block also receives the ``h`` rows on
    each side (``h`` = the widest frame reach), the ROWS frames run per (slice,
    block) and each block keeps its own rows.  Frames never reach past the halo,
    so the result equals the unblocked window.

    The numbered series is kept in the session's checkpoint directory: the
    upstream aggregation runs once.  ``ranges`` is the number of range
    partitions (default: the session's shuffle partitions)."""
    h = max(rules.half_window, rules.shift_span if rules.shift_enabled else 0, 1)
    if block_rows < h:
        raise ValueError(f"block_rows must be at least {h}")
    idx = period_index(series, spec, key_cols, ranges)
    b = block_rows
    # A NULL period is a period like any other: it sorts first.
    copies = (f"filter(array(named_struct('_blk', _i DIV {b}, '_own', true), "
              f"named_struct('_blk', _i DIV {b} - 1, '_own', false), "
              f"named_struct('_blk', _i DIV {b} + 1, '_own', false)), "
              f"x -> x._own OR (x._blk = _i DIV {b} - 1 AND _i % {b} < {h}) "
              f"OR (x._blk = _i DIV {b} + 1 AND _i % {b} >= {b - h}))")
    spread = idx.selectExpr("*", f"inline({copies})")
    # Ordering by time within (slice, block) equals ordering by _i.
    out = detect(spread, spec, rules, [*key_cols, "_blk"])
    return out.filter("_own").drop("_blk", "_own", "_i")


def detect_slice(df: DataFrame, spec: AnalysisSpec, rules: RuleSet, values=None) -> DataFrame:
    """``detect`` on one slice of the fact table (``values``: F1 slice dict,
    ``None`` = all rows): the single-series form of the detector."""
    from .series import period_totals

    return detect(period_totals(df, spec, values), spec, rules)
