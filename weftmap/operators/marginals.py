"""Marginals and totals of symmetric matrices, in one pass over the pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Genome
from .pixels import is_cis

PAIR = ["chrom1", "chrom2"]


def ends(pixels: DataFrame, *values: str) -> DataFrame:
    """A row for each bin that a pixel counts in: chrom1, chrom2, side, b, values.

    Within one chromosome both bins are of side 1, and a pixel on the diagonal counts
    once. The pixels are scanned once, not once a side.
    """
    one = lambda side, b: F.struct(F.lit(side).alias("side"), F.col(b).alias("b"))
    where = F.when(is_cis() & (F.col("b1") == F.col("b2")), F.array(one(1, "b1"))).when(is_cis(), F.array(one(1, "b1"), one(1, "b2"))).otherwise(F.array(one(1, "b1"), one(2, "b2")))
    return pixels.select(*PAIR, F.explode(where).alias("e"), *values).select(*PAIR, "e.side", "e.b", *values)


def marginals(pixels: DataFrame, **sums: str) -> DataFrame:
    """chrom1, chrom2, side, b and a sum for each keyword, of the column it names; by default m, of n.

    NaNs count as 0.
    """
    sums = sums or {"m": "n"}
    types = dict(pixels.dtypes)
    plain = lambda c: F.nanvl(F.col(c), F.lit(0.0)) if types[c] in ("double", "float") else F.col(c)
    values = sorted(set(sums.values()))
    return ends(pixels, *values).groupBy(*PAIR, "side", "b").agg(*[F.sum(plain(c)).alias(name) for name, c in sums.items()])


def totals_of_marginals(margins: DataFrame, **sums: str) -> DataFrame:
    """Totals of each pair from its marginals: side 1 alone holds every contact, both halves of one's own."""
    return margins.where("side = 1").groupBy(*PAIR).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def totals(pixels: DataFrame, value: str = "n") -> DataFrame:
    """chrom1, chrom2, total, nnz: pixels off the diagonal of one's own matrix count twice."""
    twice = F.when(is_cis() & (F.col("b1") != F.col("b2")), 2).otherwise(1)
    v = F.nanvl(F.col(value), F.lit(0.0)) if dict(pixels.dtypes)[value] == "double" else F.col(value)
    return pixels.groupBy(*PAIR).agg(F.sum(v * twice).alias("total"), F.sum(twice.cast("long")).alias("nnz"))


def nnz_average(sums: DataFrame) -> DataFrame:
    """Mean over non-zero cells, 0 without any."""
    return sums.select(*PAIR, F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("nnz")), F.lit(0.0)).alias("avg"))


def dense_sides(genome: Genome, spark, kind: str = "all") -> DataFrame:
    """All bins of all pairs and sides: chrom1, chrom2, side, b."""
    pairs = genome.pair_table(spark, kind)
    sides = F.when(is_cis(), F.array(F.struct(F.lit(1).alias("side"), F.col("bins1").alias("bins")))).otherwise(
        F.array(F.struct(F.lit(1).alias("side"), F.col("bins1").alias("bins")), F.struct(F.lit(2).alias("side"), F.col("bins2").alias("bins")))
    )
    rows = pairs.select(*PAIR, F.explode(sides).alias("s")).where("s.bins > 0")
    return rows.select(*PAIR, "s.side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.bins") - 1)).alias("b"))


def prefix_sums(margins: DataFrame, mask: DataFrame | None, genome: Genome, *values: str, kind: str = "all") -> DataFrame:
    """Sums over all bins below b, for b from 0 to the number of bins: values and masked (a count).

    Differences of two of these rows are sums over intervals.
    """
    spark = margins.sparkSession
    one_more = genome.pair_table(spark, kind)
    last = one_more.select(*PAIR, F.lit(1).alias("side"), F.col("bins1").alias("b")).union(one_more.where(~is_cis()).select(*PAIR, F.lit(2), F.col("bins2")))
    rows = dense_sides(genome, spark, kind).union(last).join(margins, [*PAIR, "side", "b"], "left")
    if mask is None:
        rows = rows.withColumn("is_masked", F.lit(0).cast("long"))
    else:
        rows = rows.join(mask.select(*PAIR, "side", "b", F.lit(1).cast("long").alias("is_masked")), [*PAIR, "side", "b"], "left")
    before = W.partitionBy(*PAIR, "side").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(*PAIR, "side", "b", *[F.coalesce(F.sum(zero(v)).over(before), F.lit(0)).alias(v) for v in values], F.coalesce(F.sum(zero("is_masked")).over(before), F.lit(0)).alias("masked"))
