"""view: rows of a result within ranges and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..functions.text import parse_range


def _side(text: str, k: int) -> Column:
    wanted = parse_range(text)
    if wanted is None:
        return F.lit(True)
    chrom, start, end = wanted
    at = F.col(f"start{k}")
    return (F.col(f"chrom{k}") == chrom) & (at >= start) & (at < end)


def view(results: DataFrame, range1: str = "all", range2: str = "all", pvalue: float = 1.0, log_ratio: float = float("-inf")) -> DataFrame:
    """Rows that begin in range1 and range2, with a p-value (corrected, if there is one) of
    pvalue or less; a finite log ratio below log_ratio drops a row. Ranges and p-values
    reach the scan."""
    p = "pvalue_corrected" if "pvalue_corrected" in results.columns else "pvalue"
    rows = results.where(_side(range1, 1) & _side(range2, 2)).where(~(F.col(p) > pvalue))
    return rows if log_ratio == float("-inf") else rows.where(~(finite(F.col("log_ratio")) & (F.col("log_ratio") < log_ratio)))
