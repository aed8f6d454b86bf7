"""validate: two results held against each other, by their coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import is_close
from ..model import COORDINATES


def compare(expected: DataFrame, found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(chrom1 ... end2, status, differing): a row for each rectangle that isn't the same in both.

    status: missing, unexpected or different; differing names the columns whose values
    differ by more than a relative tolerance. A rectangle is expected once in each.
    """
    values = [c for c in expected.columns if c not in COORDINATES]
    a = expected.select(*COORDINATES, F.struct(*values).alias("a"))
    b = found.select(*COORDINATES, F.struct(*values).alias("b"))
    both = a.join(b, list(COORDINATES), "full_outer")
    differs = [F.when(~is_close(F.col(f"a.{c}").cast("double"), F.col(f"b.{c}").cast("double"), tolerance), F.lit(c)) for c in values]
    missing, unexpected = F.col("b").isNull(), F.col("a").isNull()
    names = F.when(~missing & ~unexpected, F.concat_ws(",", *differs)).otherwise("")
    status = F.when(missing, "missing").when(unexpected, "unexpected").when(names != "", "different")
    return both.select(*COORDINATES, status.alias("status"), names.alias("differing")).where("status is not null")
