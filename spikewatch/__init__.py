"""spikewatch: period anomaly analysis on Spark DataFrames."""

from .plans.analysis import PeriodAnomalyAnalysis
from .plans.job import run_job
from .sources.config import load_config
from .spec import DETECT, EDA, SCREEN, AnalysisSpec, RuleSet, spec_from_roles

__all__ = ["PeriodAnomalyAnalysis", "AnalysisSpec", "RuleSet", "DETECT", "SCREEN", "EDA", "spec_from_roles",
           "run_job", "load_config"]
