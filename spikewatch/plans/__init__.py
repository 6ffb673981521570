from .analysis import PeriodAnomalyAnalysis
from .chart import bands, chart_points, flag_filter, multi_rule, overlay, reported_axis
from .job import run_job
from .report import report_lines

__all__ = ["PeriodAnomalyAnalysis", "bands", "chart_points", "flag_filter", "multi_rule",
           "overlay", "reported_axis", "report_lines", "run_job"]
