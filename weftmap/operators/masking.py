"""Bin masks: outliers by median absolute deviation, masks given by the user, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Genome
from .marginals import PAIR, dense_sides, marginals

SIDE = [*PAIR, "side"]


def mad_mask(margins: DataFrame, genome: Genome, k: float, kind: str = "all") -> DataFrame:
    """Masked bins (chrom1, chrom2, side, b) of all pairs of a kind.

    margins: chrom1, chrom2, side, b, m over all pixels, without band. Marginals are
    divided by the median of the positive ones; masked is what is below
    exp(median(L) - k MAD(L)), L being logarithms of the positive ones. Bins without any
    count are below, a pair without any is masked as a whole; k = 0 masks nothing but
    such pairs.
    """
    spark = margins.sparkSession
    dense = dense_sides(genome, spark, kind)
    positive = margins.where("m > 0")
    present = positive.select(*PAIR).distinct()
    if k == 0:
        return dense.join(present, PAIR, "left_anti").select(*SIDE, "b")
    middle = positive.groupBy(*SIDE).agg(F.median("m").alias("middle"))
    logs = positive.join(middle, SIDE).select(*SIDE, "b", (F.col("m") / F.col("middle")).alias("x"), F.log(F.col("m") / F.col("middle")).alias("l"))
    centre = logs.groupBy(*SIDE).agg(F.median("l").alias("centre"))
    spread = logs.join(centre, SIDE).groupBy(*SIDE, "centre").agg(F.median(F.abs(F.col("l") - F.col("centre"))).alias("mad"))
    cutoff = spread.select(*SIDE, F.exp(F.col("centre") - F.lit(k) * F.col("mad")).alias("cutoff"))
    kept = logs.join(cutoff, SIDE).where("x >= cutoff").select(*SIDE, "b")
    return dense.join(kept, [*SIDE, "b"], "left_anti").select(*SIDE, "b")


def seed_mask(bins: DataFrame, genome: Genome, kind: str = "all") -> DataFrame:
    """A user's mask (chrom, b) laid on all pairs and sides of its chromosomes."""
    pairs = genome.pair_table(bins.sparkSession, kind)
    first = pairs.join(bins, F.col("chrom1") == F.col("chrom")).select(*PAIR, F.lit(1).alias("side"), "b")
    second = pairs.where("chrom1 <> chrom2").join(bins, F.col("chrom2") == F.col("chrom")).select(*PAIR, F.lit(2).alias("side"), "b")
    return first.union(second)


def union_masks(*masks: DataFrame) -> DataFrame:
    """Bins masked by any of the masks."""
    out = masks[0].select(*SIDE, "b")
    for mask in masks[1:]:
        out = out.union(mask.select(*SIDE, "b"))
    return out.distinct()


def bin_mask(pixels: DataFrame, genome: Genome, k: float, user: DataFrame | None = None, kind: str = "all") -> DataFrame:
    """The mask used by the test: outliers of each pair and side, and what the user masks."""
    found = mad_mask(marginals(pixels), genome, k, kind)
    return union_masks(found, seed_mask(user, genome, kind)) if user is not None else found
