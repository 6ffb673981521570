"""The full analysis as one object of lazily built DataFrames.

Stages (each a property, built on first use):

  screened   per-value series of every test column, screening rules   (scan 1)
  counts     flagged periods per value                                  A4
  top        most anomalous value per test column                       A6
  lattice    series of every subset of the top values                   (scan 2)
  detected   detection rules on every lattice series                    D1-D8
  found      flagged (slice, period) rows with rule names               F2, A8
  selected   most specific slice per flagged period                     W7
  report     text report lines                                          R2
  base, bands, points, axis, overlay: chart tables                      O1-O6

Two actions run the whole analysis: the screening pass ends in the top
values (at most one per test column, collected as lattice parameters), then
the lattice pass.  The fact table is read twice in total, however many test
columns there are (the reference runs k + 2^k scans).  Everything downstream
of the two scans is small (values x periods and 2^k x periods rows).  With
``materialize=True`` those two small results are checkpointed into the
cluster's checkpoint directory, so later actions (report, charts, findings)
neither re-scan the fact table nor depend on lost executors' shuffle files.
"""

from __future__ import annotations

from functools import cached_property
from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attribute import findings, most_specific, report_order
from ..operators.lattice import subset_series
from ..operators.rules import detect
from ..operators.screening import anomaly_counts, top_values, value_series
from ..operators.series import period_totals
from ..session import ensure_checkpoint_dir
from ..spec import DETECT, SCREEN, AnalysisSpec, RuleSet
from . import chart
from .report import report_lines


class PeriodAnomalyAnalysis:
    def __init__(self, df: DataFrame, spec: AnalysisSpec, detect_rules: RuleSet = DETECT,
                 screen_rules: RuleSet = SCREEN, materialize: bool = False,
                 block_rows: Optional[int] = None):
        if not spec.test_cols:
            raise ValueError("the analysis needs at least one test column")
        self.df = df
        self.spec = spec
        self.detect_rules = detect_rules
        self.screen_rules = screen_rules
        self.materialize = materialize
        # Long time axes: run every series window in blocks of this many
        # periods (identical results; see rules.blocked_detect).
        self.block_rows = block_rows

    def _keep(self, df: DataFrame) -> DataFrame:
        if not self.materialize:
            return df
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)

    @cached_property
    def projected(self) -> DataFrame:
        s = self.spec
        cols = [s.time_col, s.metric_col, *s.test_cols, *[s.desc_cols[c] for c in s.test_cols if c in s.desc_cols]]
        return self.df.select(*dict.fromkeys(cols))

    @cached_property
    def screened(self) -> DataFrame:
        return value_series(self.projected, self.spec, self.screen_rules, self.block_rows)

    @cached_property
    def counts(self) -> DataFrame:
        return self._keep(anomaly_counts(self.screened))

    @cached_property
    def top(self) -> DataFrame:
        return top_values(self.counts)

    @cached_property
    def top_map(self) -> dict[str, str]:
        """The top values as driver-side parameters of the lattice pass.  The
        collected table has at most one row per test column (row_number = 1
        per variable), so this is a bounded, tiny action."""
        rows = self.top.select("variable", "value").collect()
        if len(rows) > len(self.spec.test_cols):
            raise AssertionError("more than one top value per test column")
        return {r["variable"]: r["value"] for r in rows}

    @cached_property
    def lattice(self) -> DataFrame:
        """Subset series of the top values (passed as literals; see
        ``top_map``).  ``subset_series`` also accepts the ``top`` DataFrame,
        which keeps everything in one plan via a scalar subquery; measured
        locally, the literal form runs faster and the work is the same."""
        return self._keep(subset_series(self.projected, self.spec, self.top_map))

    @cached_property
    def detected(self) -> DataFrame:
        return detect(self.lattice, self.spec, self.detect_rules, key_cols=["slice_ordinal"],
                      block_rows=self.block_rows)

    @cached_property
    def found(self) -> DataFrame:
        return findings(self.detected)

    @cached_property
    def selected(self) -> DataFrame:
        return most_specific(self.found, self.spec)

    def ordered(self) -> DataFrame:
        """Selected findings in report order (a sorted DataFrame)."""
        return self.selected.orderBy(*report_order(self.spec))

    @cached_property
    def report(self) -> DataFrame:
        return report_lines(self.selected, self.spec, self.detect_rules)

    @cached_property
    def base(self) -> DataFrame:
        """The unsliced series (subset 0) with the detection columns: period
        totals of the fact table, without screening or lattice."""
        totals = period_totals(self.projected, self.spec)
        return detect(totals, self.spec, self.detect_rules, block_rows=self.block_rows).withColumn("slice_key", F.lit("all"))

    def bands(self) -> DataFrame:
        return chart.bands(self.base, self.detect_rules)

    def points(self) -> DataFrame:
        return chart.lattice_points(self.detected, self.spec)

    def axis(self) -> DataFrame:
        return chart.lattice_axis(self.detected, self.spec)

    def overlay(self) -> DataFrame:
        """The unsliced series and the full subset; only these two are built."""
        ordinals = [0, self.spec.n_subsets() - 1]
        if self.materialize:
            return chart.overlay(self.detected, self.spec, ordinals)
        two = subset_series(self.projected, self.spec, self.top_map, wanted=ordinals)
        return chart.overlay(detect(two, self.spec, self.detect_rules, key_cols=["slice_ordinal"], block_rows=self.block_rows),
                             self.spec, ordinals)
