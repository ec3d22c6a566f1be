"""Repeated hold-out ablation with constrained regression, as Spark DataFrames."""

from holdfast.config import AblationConfig, log_pyrolysis, multi_basin, pyrolysis_hi
from holdfast.operators.models import Booster
from holdfast.operators.refine import RefineConfig
from holdfast.plans.prepare import prepare_log_pyrolysis, prepare_multi_basin, prepare_pyrolysis_hi, standard_names
from holdfast.plans.study import AblationResult, Study, run_ablation, write_reports

__all__ = [
    "AblationConfig",
    "AblationResult",
    "Booster",
    "RefineConfig",
    "Study",
    "log_pyrolysis",
    "multi_basin",
    "prepare_log_pyrolysis",
    "prepare_multi_basin",
    "prepare_pyrolysis_hi",
    "pyrolysis_hi",
    "run_ablation",
    "standard_names",
    "write_reports",
]
