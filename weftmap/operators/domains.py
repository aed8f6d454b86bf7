"""Domains: products of intervals, overlap with pixels, coverage, sums of marginals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import COORDINATES, Genome, maybe_broadcast
from .marginals import PAIR, prefix_sums
from .pixels import is_cis

BED = ["chrom", "start", "end"]


def distinct_domains(domains: DataFrame) -> DataFrame:
    """Distinct rectangles; or distinct intervals, if there is one chromosome column."""
    return domains.select(*(COORDINATES if "chrom1" in domains.columns else BED)).distinct()


def known_only(domains: DataFrame, genome: Genome) -> DataFrame:
    """Drop intervals on chromosomes that the genome doesn't have."""
    return domains.where(F.col("chrom").isin(*genome.ids))


def select_chroms(domains: DataFrame, chrom1: str | None, chrom2: str | None = None) -> DataFrame:
    """Rectangles between two chromosomes; chrom2 defaults to chrom1."""
    if chrom1 is None:
        return domains
    return domains.where((F.col("chrom1") == chrom1) & (F.col("chrom2") == (chrom2 or chrom1)))


def domain_product(domains: DataFrame, genome: Genome, kind: str = "all", tiles: int = 64) -> DataFrame:
    """All pairs of distinct intervals of the upper triangle, with themselves: chrom1 ... end2.

    Intervals are ordered by chromosome id, start and end. The output is the work, so first
    intervals are dealt to tiles and second ones copied to each: pairs of chromosomes, of
    which there may be one, spread over as many tasks.
    """
    rows = distinct_domains(known_only(domains, genome)).withColumn("id", genome.id_of(F.col("chrom")))
    left = rows.select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("id").alias("id1"), F.pmod(F.xxhash64("chrom", "start", "end"), F.lit(tiles)).cast("int").alias("tile"))
    right = rows.select(F.col("chrom").alias("chrom2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("id").alias("id2"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    if kind == "cis":
        return left.join(right, (left["tile"] == right["tile"]) & (F.col("id1") == F.col("id2")) & (F.struct("start1", "end1") <= F.struct("start2", "end2"))).select(*COORDINATES)
    pairs = genome.pair_table(domains.sparkSession, kind).select(*PAIR)
    joined = left.join(F.broadcast(pairs), "chrom1").join(right, ["chrom2", "tile"])
    ordered = (F.col("chrom1") != F.col("chrom2")) | (F.struct("start1", "end1") <= F.struct("start2", "end2"))
    return joined.where(ordered).select(*COORDINATES)


def tiled_order(genome: Genome) -> list[Column]:
    return [genome.id_of(F.col("chrom1")), genome.id_of(F.col("chrom2")), *map(F.col, ("start1", "start2", "end1", "end2"))]


def linear_order(genome: Genome) -> list[Column]:
    return [genome.id_of(F.col("chrom1")), F.col("start1"), F.col("end1"), genome.id_of(F.col("chrom2")), F.col("start2"), F.col("end2")]


def overlap_sums(pixels: DataFrame, domains: DataFrame, genome: Genome, **sums: str) -> DataFrame:
    """domains and a sum for each keyword over the pixels that overlap each; 0 without any.

    Both are cut by bins of the first axis: a domain has a row for each bin of its shorter
    side, which joins pixels of that bin by equality; the other axis is a range condition.
    Within a chromosome a pixel off the diagonal also stands for its mirror image, so it
    counts twice in a domain that holds both. No pair of rectangles meets but in the bins
    they share.
    """
    sums = sums or {"obs": "n"}
    r = genome.resolution
    keyed = domains.select(*COORDINATES)
    bins = keyed.select(
        *COORDINATES,
        F.floor(F.col("start1") / r).alias("lo1"), F.ceil(F.col("end1") / r).alias("hi1"),
        F.floor(F.col("start2") / r).alias("lo2"), F.ceil(F.col("end2") / r).alias("hi2"),
    ).where("lo1 < hi1 and lo2 < hi2")
    by_first = F.col("hi1") - F.col("lo1") <= F.col("hi2") - F.col("lo2")
    cut = bins.select(
        *COORDINATES, F.when(by_first, 1).otherwise(2).alias("axis"),
        F.explode(F.when(by_first, F.sequence("lo1", F.col("hi1") - 1)).otherwise(F.sequence("lo2", F.col("hi2") - 1))).alias("key"),
        F.when(by_first, F.col("lo2")).otherwise(F.col("lo1")).alias("lo"), F.when(by_first, F.col("hi2")).otherwise(F.col("hi1")).alias("hi"),
    )
    values = sorted(set(sums.values()))
    # a pixel is probed by both axes, and off the diagonal with its bins swapped too
    view = lambda axis, key, other: F.struct(F.lit(axis).alias("axis"), F.col(key).alias("key"), F.col(other).alias("other"))
    straight = [view(1, "b1", "b2"), view(2, "b2", "b1")]
    mirrored = [view(1, "b2", "b1"), view(2, "b1", "b2")]
    views = F.when(is_cis() & (F.col("b1") != F.col("b2")), F.array(*straight, *mirrored)).otherwise(F.array(*straight))
    probes = pixels.select(*PAIR, F.explode(views).alias("v"), *values).select(*PAIR, "v.axis", "v.key", "v.other", *values)
    hits = probes.join(cut, [*PAIR, "axis", "key"]).where("other >= lo and other < hi")
    found = hits.groupBy(*COORDINATES).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    joined = keyed.join(found, list(COORDINATES), "left")
    zero = {name: F.coalesce(F.col(name), F.lit(0)) for name in sums}
    return joined.withColumns(zero).select(*COORDINATES, *sums)


def coverage(domains: DataFrame, genome: Genome, block: int = 100_000) -> DataFrame:
    """(chrom1, chrom2, covered, blocks, coverage): the share of block-wide cells of the upper
    triangle that a domain, or its mirror image, touches; pairs without domains are left out.

    A domain has a row for each line of cells it touches, an interval; the cells of a line
    are the union of its intervals, found by a running maximum.
    """
    width = F.lit(max(block, genome.resolution)).cast("long")
    side = lambda k: [F.floor(F.col(f"start{k}") / width).alias(f"lo{k}"), F.floor((F.col(f"end{k}") - 1) / width).alias(f"hi{k}")]
    spans = domains.select(*PAIR, *side(1), *side(2)).distinct()
    # a row of cells for each x, from lo to hi; within a chromosome also of the mirror image, above the diagonal
    line = lambda x, y: F.struct(F.col(f"lo{x}").alias("first"), F.col(f"hi{x}").alias("last"), F.col(f"lo{y}").alias("lo"), F.col(f"hi{y}").alias("hi"))
    views = spans.select(*PAIR, F.explode(F.when(is_cis(), F.array(line(1, 2), line(2, 1))).otherwise(F.array(line(1, 2)))).alias("v"))
    lines = views.select(*PAIR, F.explode(F.sequence("v.first", "v.last")).alias("x"), "v.lo", "v.hi")
    lines = lines.withColumn("lo", F.when(is_cis(), F.greatest("lo", "x")).otherwise(F.col("lo"))).where("lo <= hi")
    before = W.partitionBy(*PAIR, "x").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    new = F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before) + 1, F.col("lo"))) + 1
    touched = lines.select(*PAIR, F.greatest(new, F.lit(0)).alias("new")).groupBy(*PAIR).agg(F.sum("new").alias("covered"))
    n1, n2 = (F.ceil(genome.size_of(F.col(c)) / width) for c in PAIR)
    blocks = F.when(is_cis(), (n1 * (n1 + 1) / 2).cast("long")).otherwise(n1 * n2)
    return touched.select(*PAIR, "covered", blocks.alias("blocks"), (F.col("covered") / blocks).alias("coverage"))


def domain_marginals(domains: DataFrame, margins: DataFrame, mask: DataFrame | None, genome: Genome, kind: str = "all") -> DataFrame:
    """domains and n1, n2 (sums of column m of margins), l1, l2 (of lm), bad1, bad2 (masked share of bins).

    Sums over intervals are differences of two prefix sums, found by two lookups a side.
    """
    r = genome.resolution
    before = prefix_sums(margins, mask, genome, "m", "lm", kind=kind)
    most = 2 * genome.side_rows(kind)
    out = domains.withColumns(
        {"i1": F.floor(F.col("start1") / r), "j1": F.ceil(F.col("end1") / r), "i2": F.floor(F.col("start2") / r), "j2": F.ceil(F.col("end2") / r), "__side2": F.when(is_cis(), 1).otherwise(2)}
    )
    for side, place in ((1, "i"), (1, "j"), (2, "i"), (2, "j")):
        name = f"{place}{side}"
        at = before.select(*PAIR, F.col("side").alias("__s"), F.col("b").alias(name), F.struct("m", "lm", "masked").alias(f"__{name}"))
        if side == 1:
            at = at.where("__s = 1").drop("__s")
            out = out.join(maybe_broadcast(at, most), [*PAIR, name], "left")
        else:
            out = out.join(maybe_broadcast(at.withColumnRenamed("__s", "__side2"), most), [*PAIR, "__side2", name], "left")
    diff = lambda k, v: F.col(f"__j{k}.{v}") - F.col(f"__i{k}.{v}")
    bad = lambda k: F.coalesce(F.try_divide(diff(k, "masked").cast("double"), F.col(f"j{k}") - F.col(f"i{k}")), F.lit(0.0))
    return out.select(*domains.columns, diff(1, "m").alias("n1"), diff(2, "m").alias("n2"), diff(1, "lm").alias("l1"), diff(2, "lm").alias("l2"), bad(1).alias("bad1"), bad(2).alias("bad2"))


def chrom_runs(domains: DataFrame, order: str) -> DataFrame:
    """(chrom, first, last, runs): where each chromosome stands in a file's order, and in how many runs.

    order: the column with the line numbers. More than one run: the file is unsorted.
    """
    w = W.orderBy(order)
    starts = domains.select("chrom", F.col(order).alias("i"), F.when(F.lag("chrom").over(w) == F.col("chrom"), 0).otherwise(1).alias("new"))
    return starts.groupBy("chrom").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sum("new").alias("runs"))
