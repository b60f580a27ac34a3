"""PySpark-native engine for evidence-grounded evaluation of structured extraction."""

from .operators.dedup import greedy, staged
from .operators.evaluate import MatchPolicy, bootstrap, evaluate, evaluate_by_slice, field_metrics, quote_check
from .operators.extract import LLMExtractor, QAExtractor, RegexExtractor, predict, predict_cells
from .operators.frames import read_csv, to_long, to_wide, validate, write_csv
from .operators.reconcile import Report, reconcile
from .operators.sampling import build_splits, iaa_subset, leakage, proportional_quotas, quota_sample, slice_summary
from .schema import HEADLINE, NR, NUMERIC, UNITS

__all__ = [
    "HEADLINE", "NR", "NUMERIC", "UNITS", "LLMExtractor", "MatchPolicy", "QAExtractor", "RegexExtractor", "Report", "bootstrap", "build_splits", "evaluate",
    "evaluate_by_slice", "field_metrics", "greedy", "iaa_subset", "leakage", "predict", "predict_cells", "proportional_quotas", "quota_sample", "quote_check", "read_csv",
    "reconcile", "slice_summary", "staged", "to_long", "to_wide", "validate", "write_csv",
]
