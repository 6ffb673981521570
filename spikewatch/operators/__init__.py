from .describe import code_descriptions, describe_values
from .attribute import findings, most_specific, ranked_findings, report_order
from .lattice import subset_series
from .profile import data_profile, null_profile, type_profile
from .rules import apply_rules, blocked_detect, detect, detect_slice, period_index, rolling_columns
from .screening import anomaly_counts, top_values, value_series
from .series import (hour_start, period_totals, role_projection, slice_condition, slice_filter,
                     value_totals, week_start)

__all__ = ["code_descriptions", "describe_values", "findings", "most_specific", "ranked_findings", "report_order", "subset_series",
           "data_profile", "null_profile", "type_profile", "apply_rules", "detect", "detect_slice",
           "rolling_columns", "blocked_detect", "period_index", "anomaly_counts", "top_values", "value_series", "hour_start",
           "period_totals", "role_projection", "slice_condition", "slice_filter", "value_totals",
           "week_start"]
