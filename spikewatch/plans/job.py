"""The whole batch job: profile, analysis, report and chart tables written
under one output folder (the reference's end-to-end run, as Spark writes).

Layout under ``out_dir``:

  preprocessing/null_counts/   CSV  Column,Null Count
  preprocessing/data_types/    CSV  Column,Data Type
  <time_col>/outliers_summary/ text report (one file)
  <time_col>/chart_*/          parquet chart tables (bands, points, axis, overlay)
  EDA/outlier_results/         per-slice series CSV (optional)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..operators.profile import null_profile, type_profile
from ..sources.sinks import write_profile, write_report, write_series
from ..spec import DETECT, SCREEN, AnalysisSpec, RuleSet
from .analysis import PeriodAnomalyAnalysis


def run_job(df: DataFrame, spec: AnalysisSpec, out_dir: str, detect_rules: RuleSet = DETECT,
            screen_rules: RuleSet = SCREEN, materialize: bool = True,
            series: bool = False, block_rows: int | None = None) -> PeriodAnomalyAnalysis:
    """Run every stage and write every output; returns the analysis object
    (its DataFrames stay usable).  With ``materialize`` the two small pass
    results are checkpointed first, so the outputs below never re-scan the
    fact table."""
    write_profile(null_profile(df), os.path.join(out_dir, "preprocessing", "null_counts"))
    write_profile(type_profile(df), os.path.join(out_dir, "preprocessing", "data_types"))
    if not spec.test_cols:
        return None
    a = PeriodAnomalyAnalysis(df, spec, detect_rules, screen_rules, materialize=materialize,
                              block_rows=block_rows)
    base = os.path.join(out_dir, spec.time_col)
    write_report(a.report, os.path.join(base, "outliers_summary"))
    for name, table in (("bands", a.bands()), ("points", a.points()), ("axis", a.axis()),
                        ("overlay", a.overlay())):
        table.write.mode("overwrite").parquet(os.path.join(base, f"chart_{name}"))
    if series:
        write_series(a.detected, spec, os.path.join(out_dir, "EDA", "outlier_results"))
    return a
