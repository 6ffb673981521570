"""Analysis parameters: column roles and rule profiles.

An ``AnalysisSpec`` says which column is the time axis, which is the metric and
which columns are the dimensions ("test variables") to slice by.  A ``RuleSet``
holds the thresholds of the anomaly rules.  Both are plain driver-side values;
they only shape the Spark plans and never carry data.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import comb
from typing import Mapping, Optional, Sequence

# Zero-mean guard placements (see ``RuleSet.zero_mean_guard``).
GUARD_NONE = "none"
GUARD_AFTER_Z = "after_z"
GUARD_BEFORE_Z = "before_z"


@dataclass(frozen=True)
class RuleSet:
    """Thresholds of the rolling-window rules; ``None`` disables a rule.

    z rule        |x - mean| / std > z_cut over a centred window of
                  ``2 * half_window + 1`` rows (false when std = 0).
    jump rule     x >= jump_up * prev or x <= jump_down * prev, and
                  |x - prev| > jump_min_abs.
    shift rule    mean of the next ``shift_span`` rows against the mean of the
                  previous ``shift_span`` rows: one at least ``shift_ratio``
                  times the other, and |next - prev| > shift_min_abs.
    count rule    row count ratio >= count_ratio or <= 1 / count_ratio against
                  the previous period, and the larger count > count_min.
    """

    z_cut: Optional[float] = 2.1
    jump_up: Optional[float] = 3.0
    jump_down: Optional[float] = 0.33
    jump_min_abs: Optional[float] = 5000.0
    shift_ratio: Optional[float] = 2.0
    shift_min_abs: Optional[float] = 8000.0
    count_ratio: Optional[float] = None
    count_min: Optional[float] = None
    half_window: int = 3
    shift_span: int = 3
    backfill_first: bool = True
    zero_mean_guard: str = GUARD_AFTER_Z

    def __post_init__(self):
        if self.half_window < 1 or self.shift_span < 1:
            raise ValueError("half_window and shift_span must be at least 1")
        if self.zero_mean_guard not in (GUARD_NONE, GUARD_AFTER_Z, GUARD_BEFORE_Z):
            raise ValueError(f"unknown zero_mean_guard {self.zero_mean_guard!r}")
        for name in ("jump_up", "shift_ratio", "count_ratio"):
            v = getattr(self, name)
            if v is not None and v <= 0:
                raise ValueError(f"{name} must be positive")

    def with_(self, **changes) -> "RuleSet":
        return replace(self, **changes)

    @property
    def jump_enabled(self) -> bool:
        return (self.jump_up is not None or self.jump_down is not None) and self.jump_min_abs is not None

    @property
    def shift_enabled(self) -> bool:
        return self.shift_ratio is not None and self.shift_min_abs is not None

    @property
    def count_enabled(self) -> bool:
        return self.count_ratio is not None and self.count_min is not None


# The three rule profiles of the reference.
# DETECT: the detector run on every slice of the lattice and on the full data.
DETECT = RuleSet(
    z_cut=2.1, jump_up=3.0, jump_down=0.33, jump_min_abs=5000.0,
    shift_ratio=2.0, shift_min_abs=8000.0, count_ratio=None, count_min=None,
    backfill_first=True, zero_mean_guard=GUARD_AFTER_Z,
)
# SCREEN: the per-value screening that picks the most anomalous value.
SCREEN = RuleSet(
    z_cut=2.1, jump_up=2.0, jump_down=0.5, jump_min_abs=5000.0,
    shift_ratio=2.0, shift_min_abs=8000.0, count_ratio=None, count_min=None,
    backfill_first=False, zero_mean_guard=GUARD_NONE,
)
# EDA: the older exploratory profile (row-count rule, no change point).
EDA = RuleSet(
    z_cut=2.0, jump_up=2.0, jump_down=0.5, jump_min_abs=600.0,
    shift_ratio=None, shift_min_abs=None, count_ratio=2.0, count_min=10.0,
    backfill_first=True, zero_mean_guard=GUARD_NONE,
)

# Rule names as they appear in findings, in reporting order.
RULE_Z = "z_score"
RULE_JUMP = "metric"
RULE_SHIFT = "change"
RULE_COUNT = "count"


@dataclass(frozen=True)
class AnalysisSpec:
    """Column roles of one analysis.

    time_col     period column (string, date, timestamp or number; sortable).
    metric_col   numeric column totalled per period.
    test_cols    dimension columns sliced by, in order (lattice and report order).
    desc_cols    optional map dimension -> description column for the report.
    metric_scale None (default): the metric is summed as given.  A number of
                 decimal places opts in to sums of exact integer units (cents
                 for 2) and fails on values that are no whole units.
    period_noun  plural noun for the change section of the report; derived from
                 the time column name when not given.
    """

    time_col: str
    metric_col: str
    test_cols: Sequence[str] = field(default_factory=tuple)
    desc_cols: Mapping[str, str] = field(default_factory=dict)
    metric_scale: Optional[int] = None
    period_noun: Optional[str] = None

    def __post_init__(self):
        object.__setattr__(self, "test_cols", tuple(self.test_cols))
        object.__setattr__(self, "desc_cols", dict(self.desc_cols))
        unknown = set(self.desc_cols) - set(self.test_cols)
        if unknown:
            raise ValueError(f"description given for non-test columns: {sorted(unknown)}")
        if len(set(self.test_cols)) != len(self.test_cols):
            raise ValueError("test columns must be distinct")
        if {self.time_col, self.metric_col} & set(self.test_cols):
            raise ValueError("the time and metric columns cannot also be test columns")
        if self.metric_scale is not None and not 0 <= self.metric_scale <= 6:
            raise ValueError("metric_scale must be within 0..6 or None")

    @property
    def noun(self) -> str:
        if self.period_noun:
            return self.period_noun
        if "week" in self.time_col:
            return "Weeks"
        if "date" in self.time_col:
            return "Days"
        return "Periods"

    def subsets(self) -> list[tuple[int, ...]]:
        """All subsets of the test columns as index tuples: by size, then in
        lexicographic order (the empty subset first, the full set last)."""
        from itertools import combinations

        k = len(self.test_cols)
        return [c for r in range(k + 1) for c in combinations(range(k), r)]

    def n_subsets(self) -> int:
        return 1 << len(self.test_cols)

    def subset_at(self, ordinal: int) -> tuple[int, ...]:
        """``subsets()[ordinal]``, without listing them."""
        k, size = len(self.test_cols), 0
        if not 0 <= ordinal < 1 << k:
            raise ValueError(f"no subset {ordinal}")
        while ordinal >= comb(k, size):
            ordinal -= comb(k, size)
            size += 1
        chosen: list[int] = []
        for i in range(k):
            if len(chosen) == size:
                break
            with_i = comb(k - 1 - i, size - len(chosen) - 1)  # combinations whose next column is i
            if ordinal < with_i:
                chosen.append(i)
            else:
                ordinal -= with_i
        return tuple(chosen)


def spec_from_roles(variables: Mapping[str, Mapping[str, object]], **kw) -> AnalysisSpec:
    """Build a spec from a role table shaped like ``{column: {flag: bool}}``:
    the first column flagged ``time_variable`` is the time axis, the first
    flagged ``metric_variable`` the metric, every one flagged ``test_variable``
    a dimension, in the given order."""
    time_col = next((c for c, d in variables.items() if d.get("time_variable")), None)
    metric_col = next((c for c, d in variables.items() if d.get("metric_variable")), None)
    tests = [c for c, d in variables.items() if d.get("test_variable")]
    if time_col is None or metric_col is None:
        raise ValueError("role table needs a time_variable and a metric_variable")
    return AnalysisSpec(time_col=time_col, metric_col=metric_col, test_cols=tests, **kw)
