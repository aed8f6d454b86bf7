"""filter: correct p-values for multiple testing and keep what is significant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FILTER_COLUMNS
from ..operators.fdr import benjamini_hochberg


def filter_results(results: DataFrame, fdr: float = 0.01, log_ratio: float = 2.0, by: str = "cis-trans", method: str = "reference", keep_all: bool = False) -> DataFrame:
    """Results with pvalue_corrected. Unless keep_all, only rows at or below fdr with at least log_ratio."""
    corrected = benjamini_hochberg(results, by, method).select(*FILTER_COLUMNS)
    return corrected if keep_all else corrected.where((F.col("pvalue_corrected") <= fdr) & (F.col("log_ratio") >= log_ratio))
