"""cartesian-product: intervals become rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Genome
from ..operators.domains import BED, chrom_runs, domain_product, select_chroms


def genome_of(domains: DataFrame, order: str) -> Genome:
    """Chromosomes in the order in which a file names them, when there is no genome.

    A row for each chromosome comes to the driver. A file that comes back to a
    chromosome after another one is refused.
    """
    runs = chrom_runs(domains, order).orderBy("first").collect()
    if bad := [r["chrom"] for r in runs if r["runs"] > 1]:
        raise ValueError(f"domains aren't sorted: {', '.join(bad[:10])} in more than one place")
    return Genome(tuple((r["chrom"], 2**31 - 1) for r in runs), 1)


def product(domains: DataFrame, genome: Genome | None = None, kind: str = "all", chrom1: str | None = None, chrom2: str | None = None, order: str = "line") -> DataFrame:
    genome = genome or genome_of(domains, order)
    if chrom1:
        domains = domains.where(F.col("chrom").isin(chrom1, chrom2 or chrom1))
    return select_chroms(domain_product(domains.select(*BED), genome, kind), chrom1, chrom2)
