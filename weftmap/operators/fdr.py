"""Benjamini-Hochberg correction, for groups of any size.

The k-th smallest of n p-values becomes min(1, p n / k); then method "reference" takes
the smaller of each value and the next one, "textbook" the smallest of all from it on.
Groups of one row are left as they are. Equal p-values are ranked by coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import clamp
from ..model import COORDINATES
from ..scratch import estimated_bytes, materialise

#: Inputs estimated above this are ranked by ranges instead of by one window a group.
WINDOW_BYTES = 256 << 20

PARTS = {"all": 0, "cis-trans": 1, "chrom-chrom": 2}


def group_columns(by: str) -> list[Column]:
    """What is corrected together: all rows, cis and trans apart, or each pair of chromosomes."""
    if by not in PARTS:
        raise ValueError(f"unknown grouping {by!r}")
    return {"all": [F.lit(0)], "cis-trans": [F.col("chrom1") == F.col("chrom2")], "chrom-chrom": [F.col("chrom1"), F.col("chrom2")]}[by]


def benjamini_hochberg(rows: DataFrame, by: str = "cis-trans", method: str = "reference", p: str = "pvalue", out: str = "pvalue_corrected", ties: tuple[str, ...] = COORDINATES, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """rows and one more column, the corrected p-values."""
    if method not in ("reference", "textbook"):
        raise ValueError(f"unknown method {method!r}")
    group = [f"__g{k}" for k in range(len(group_columns(by)))]
    keyed = rows.withColumns(dict(zip(group, group_columns(by))))
    if estimated_bytes(rows) <= window_bytes:
        found = _by_window(keyed, group, method, p, out, ties)
    else:
        found = _by_ranges(keyed, group, method, p, out, ties)
    return found.select(*rows.columns, out)


def _raw(p: Column, n: Column, rank: Column) -> Column:
    return clamp(p * n / rank)


def _by_window(keyed: DataFrame, group: list[str], method: str, p: str, out: str, ties: tuple[str, ...]) -> DataFrame:
    ordered = W.partitionBy(*group).orderBy(p, *ties)
    ranked = keyed.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*group))).withColumn("__raw", _raw(F.col(p), F.col("__n"), F.row_number().over(ordered)))
    if method == "reference":
        value = F.least("__raw", F.lead("__raw").over(ordered))
    else:
        value = F.min("__raw").over(ordered.rowsBetween(0, W.unboundedFollowing))
    return ranked.withColumn(out, F.when(F.col("__n") < 2, F.col(p)).otherwise(value))


def _by_ranges(keyed: DataFrame, group: list[str], method: str, p: str, out: str, ties: tuple[str, ...]) -> DataFrame:
    """Rows are dealt by ranges of (group, p-value, coordinates) and written; within a range
    they are numbered, and ranges are put together by their counts. So a group of any size
    is spread over all tasks; only a row for each range and group meets in one place."""
    order = [*group, p, *ties]
    dealt = materialise(keyed.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "bh")
    key = ["__range", *group]
    local = W.partitionBy(*key).orderBy(p, *ties)
    ranges = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("__here"), F.min(p).alias("__first"))
    along = W.partitionBy(*group).orderBy("__range")
    ranges = ranges.select(
        *key,
        F.coalesce(F.sum("__here").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__here").over(W.partitionBy(*group)).alias("__n"),
        F.lead("__first").over(along).alias("__next_first"),
    )
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])
    ranges = materialise(ranges, "bh-ranges")
    numbered = dealt.withColumns({"__k": F.row_number().over(local), "__next": F.lead(p).over(local)})
    joined = numbered.join(F.broadcast(ranges), same(numbered, ranges)).drop(*[ranges[k] for k in key])  # a row for each range: bounded by their number
    rank = F.col("__before") + F.col("__k")
    ranked = joined.withColumn("__raw", _raw(F.col(p), F.col("__n"), rank))
    if method == "reference":
        value = F.least("__raw", _raw(F.coalesce("__next", "__next_first"), F.col("__n"), rank + 1))
    else:
        lowest = ranked.groupBy(*key).agg(F.min("__raw").alias("__low"))
        later = lowest.select(*key, F.min("__low").over(W.partitionBy(*group).orderBy("__range").rowsBetween(1, W.unboundedFollowing)).alias("__later"))
        later = materialise(later, "bh-lowest")
        ranked = ranked.join(F.broadcast(later), same(ranked, later)).drop(*[later[k] for k in key])
        value = F.least(F.min("__raw").over(local.rowsBetween(0, W.unboundedFollowing)), "__later")
    return ranked.withColumn(out, F.when(F.col("__n") < 2, F.col(p)).otherwise(value))
