"""Pixels: coordinates, ranges, distance band, masks.

A pixel is (chrom1, chrom2, b1, b2, n): bins are numbered within their chromosome, pairs
are of the upper triangle and b1 <= b2 within one chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import UNBOUNDED, Genome, maybe_broadcast

def is_cis() -> Column:
    return F.col("chrom1") == F.col("chrom2")

def scan_pair(pixels: DataFrame, chrom1: str, chrom2: str | None = None) -> DataFrame:
    """One sub-matrix; one chromosome's own if chrom2 isn't given."""
    return pixels.where((F.col("chrom1") == chrom1) & (F.col("chrom2") == (chrom2 or chrom1)))

def scan_kind(pixels: DataFrame, kind: str = "all") -> DataFrame:
    """kind: all, cis or trans."""
    return pixels if kind == "all" else pixels.where(is_cis() if kind == "cis" else ~is_cis())

def scan_range(pixels: DataFrame, genome: Genome, range1: tuple[str, int, int], range2: tuple[str, int, int]) -> DataFrame:
    """Pixels of a rectangle: those whose bins overlap both ranges. The bounds reach the scan."""
    r = genome.resolution
    (c1, s1, e1), (c2, s2, e2) = range1, range2
    inside = lambda b, s, e: (F.col(b) >= s // r) & (F.col(b) <= (e - 1) // r)
    return scan_pair(pixels, c1, c2).where(inside("b1", s1, e1) & inside("b2", s2, e2))

def pairs_present(pixels: DataFrame) -> DataFrame:
    """Chromosome pairs that have pixels."""
    return pixels.select("chrom1", "chrom2").distinct()

def drop_empty_pairs(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    return pairs.join(pairs_present(pixels), ["chrom1", "chrom2"], "left_semi")

def with_coordinates(pixels: DataFrame, genome: Genome) -> DataFrame:
    """start1, end1, start2, end2 of the pixels' bins, by arithmetic."""
    r = F.lit(genome.resolution).cast("long")
    at = lambda b: F.col(b) * r
    end = lambda b, c: F.least((F.col(b) + 1) * r, genome.size_of(F.col(c)))
    return pixels.withColumns({"start1": at("b1"), "end1": end("b1", "chrom1"), "start2": at("b2"), "end2": end("b2", "chrom2")})

def from_thin(thin: DataFrame, genome: Genome, bin1: str = "bin1_id", bin2: str = "bin2_id", count: str = "count") -> DataFrame:
    """Pixels of (bin1_id, bin2_id, count), whose bins are numbered over the whole genome."""
    starts, at = [], 0
    for _, name, _ in genome.real:
        starts.append((name, at))
        at += genome.bins(name)

    def chrom_and_bin(column: str) -> tuple[Column, Column]:
        chrom, base = F.lit(None).cast("string"), F.lit(None).cast("long")
        for name, start in starts:
            chrom, base = F.when(F.col(column) >= start, name).otherwise(chrom), F.when(F.col(column) >= start, F.lit(start).cast("long")).otherwise(base)
        return chrom, F.col(column) - base

    (c1, b1), (c2, b2) = chrom_and_bin(bin1), chrom_and_bin(bin2)
    return thin.select(c1.alias("chrom1"), c2.alias("chrom2"), b1.alias("b1"), b2.alias("b2"), F.col(count).alias("n"))

def drop_nan_counts(pixels: DataFrame, value: str = "n") -> DataFrame:
    return pixels.where(~F.isnan(F.col(value).cast("double")))

def distance(genome: Genome) -> Column:
    return (F.col("b2") - F.col("b1")) * F.lit(genome.resolution).cast("long")

def in_band(genome: Genome, min_delta: int, max_delta: int) -> Column:
    """Within the distance band; pairs of different chromosomes always are."""
    if min_delta <= 0 and max_delta >= UNBOUNDED:
        return F.lit(True)
    # bins instead of base pairs, so that the bounds are constants
    least = -(-min_delta // genome.resolution)
    band = F.col("b2") - F.col("b1") >= F.lit(least).cast("long")
    if max_delta < UNBOUNDED:
        band = band & (distance(genome) < F.lit(max_delta).cast("long"))
    return ~is_cis() | band

def drop_masked(pixels: DataFrame, mask: DataFrame | None, genome: Genome, settled: bool = False) -> DataFrame:
    """Pixels of which neither bin is masked. mask: chrom1, chrom2, side (1 or 2), b; one's own pairs have side 1 alone.

    settled: the mask is worked out already, so it may be counted; few bins are masked.
    """
    if mask is None:
        return pixels
    most = genome.side_rows()
    first = mask.where("side = 1").select("chrom1", "chrom2", F.col("b").alias("b1"))
    own = (F.col("side") == 2) | ((F.col("chrom1") == F.col("chrom2")) & (F.col("side") == 1))
    second = mask.where(own).select("chrom1", "chrom2", F.col("b").alias("b2"))
    kept = pixels.join(maybe_broadcast(first, most, settled=settled), ["chrom1", "chrom2", "b1"], "left_anti")
    return kept.join(maybe_broadcast(second, most, settled=settled), ["chrom1", "chrom2", "b2"], "left_anti").select(*pixels.columns)

def usable(pixels: DataFrame, genome: Genome, min_delta: int, max_delta: int, mask: DataFrame | None = None, settled: bool = False) -> DataFrame:
    """In band and not masked: what statistics are made of."""
    return drop_masked(pixels.where(in_band(genome, min_delta, max_delta)), mask, genome, settled)
