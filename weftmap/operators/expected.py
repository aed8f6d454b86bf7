"""Expected values: distance profile, its repair, scaling factors, means between chromosomes."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import NAN, finite, ratio
from ..model import Genome, Params, maybe_broadcast
from ..scratch import settle, ship
from .marginals import PAIR, nnz_average, totals
from .masking import bin_mask
from .pixels import is_cis, scan_kind, usable


@dataclass(frozen=True)
class Expected:
    """Expected values as tables; a part that wasn't asked for is None.

    weights(d, w), scaling(chrom, sf), trans(chrom1, chrom2, avg), mask(chrom1, chrom2, side, b)
    """

    params: Params
    weights: DataFrame | None
    scaling: DataFrame | None
    trans: DataFrame | None
    mask: DataFrame | None

    def settled(self, genome: Genome) -> Expected:
        """The same with each part worked out once; all are bounded by the genome."""
        bounds = {"weights": genome.longest, "scaling": len(genome.chroms), "trans": len(genome.pairs("trans")), "mask": genome.side_rows()}
        return replace(self, **{k: settle(part, most, k) for k, most in bounds.items() if (part := getattr(self, k)) is not None})


def contacts_by_distance(cis: DataFrame) -> DataFrame:
    """(chrom, d, n): contacts of each chromosome at each distance; of a table that is this already, itself.

    One scan of the pixels gives the profile and the sums of chromosomes. NaNs count as 0.
    """
    if "d" in cis.columns:
        return cis
    n = F.nanvl(F.col("n"), F.lit(0.0)) if dict(cis.dtypes)["n"] in ("double", "float") else F.col("n")
    return cis.groupBy(F.col("chrom1").alias("chrom"), (F.col("b2") - F.col("b1")).alias("d")).agg(F.sum(n).alias("n"))


def observed_by_distance(cis: DataFrame) -> DataFrame:
    return contacts_by_distance(cis).groupBy("d").agg(F.sum("n").alias("obs"))


def sums_by_chrom(cis: DataFrame) -> DataFrame:
    return contacts_by_distance(cis).groupBy("chrom").agg(F.sum("n").alias("cis_sum"))


def possible_by_distance(chroms: DataFrame, genome: Genome) -> DataFrame:
    """Cells at each distance, of full bins of the chromosomes in chroms (column chrom)."""
    sized = genome.table(chroms.sparkSession).join(chroms.select("chrom").distinct(), "chrom", "left_semi").where("full_bins > 0")
    rows = sized.select("full_bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_bins") - 1)).alias("d"))
    return rows.groupBy("d").agg(F.sum(F.col("full_bins") - F.col("d")).alias("possible"))


def raw_profile(cis: DataFrame, genome: Genome) -> DataFrame:
    """(d, obs, possible) for each distance up to the longest chromosome."""
    spark = cis.sparkSession
    all_d = spark.range(genome.longest).select(F.col("id").alias("d"))
    possible = possible_by_distance(sums_by_chrom(cis), genome)
    joined = all_d.join(observed_by_distance(cis), "d", "left").join(possible, "d", "left")
    return joined.select("d", F.coalesce("obs", F.lit(0)).cast("double").alias("obs"), F.coalesce("possible", F.lit(0)).cast("double").alias("possible"))


def density(profile: DataFrame) -> DataFrame:
    """(d, w): observed over possible, NaN if either is 0."""
    return profile.select("d", F.when((F.col("obs") == 0) | (F.col("possible") == 0), F.lit(NAN)).otherwise(ratio(F.col("obs"), F.col("possible"))).alias("w"))


def pool(possible: np.ndarray, observed: np.ndarray, possible_cutoff: float, observed_cutoff: float) -> int:
    """Pool thinly covered distances, in place; the number of valid ones.

    From left to right a distance's window grows on both sides until it meets both
    cut-offs or reaches an end; if it meets one of them, its means replace the values, and
    later windows see them. Running sums of what is done on the left and of what is
    untouched on the right make each window a binary search.
    """
    m = len(observed)
    nonzero = np.flatnonzero(observed)
    if not len(nonzero):
        observed[:] = NAN
        return 0
    first, k = int(nonzero[0]), int(nonzero[-1])
    last = m if k == m - 1 else k + 2
    right_p, right_o = (np.concatenate(([0.0], np.cumsum(x))) for x in (possible, observed))
    left_p, left_o = np.zeros(m + 1), np.zeros(m + 1)
    left_p[: first + 1], left_o[: first + 1] = right_p[: first + 1], right_o[: first + 1]
    end = 0
    for i in range(first, m):
        # a window of arm a holds i-a to i+a
        widest = min(i, m - 1 - i)

        def sums(a: int, i: int = i) -> tuple[float, float]:
            p = possible[i] + left_p[i] - left_p[i - a] + right_p[i + a + 1] - right_p[i + 1]
            return p, observed[i] + left_o[i] - left_o[i - a] + right_o[i + a + 1] - right_o[i + 1]

        low, high = 0, widest
        while low < high:
            middle = (low + high) // 2
            p, o = sums(middle)
            if p < possible_cutoff or o < observed_cutoff:
                low = middle + 1
            else:
                high = middle
        p, o = sums(low)
        if p >= possible_cutoff or o >= observed_cutoff:
            end = i + low + 1
            possible[i], observed[i] = p / (2 * low + 1), o / (2 * low + 1)
        left_p[i + 1], left_o[i + 1] = left_p[i] + possible[i], left_o[i] + observed[i]
    end = min(end, last)
    observed[end:] = NAN
    return end


def smooth(w: np.ndarray, quantile: float, window_bins: int) -> None:
    """Replace outliers of a sliding window by its median, in place; later windows see it.

    Values that aren't finite are left out of the window's order statistics.
    """
    arm = window_bins // 2
    if window_bins < 2:
        return
    for i in range(arm, len(w) - arm):
        if not np.isfinite(w[i]):
            continue
        frame = w[i - arm : i + arm + 1]
        frame = np.sort(frame[np.isfinite(frame)])
        if w[i] > frame[int(quantile * (len(frame) - 1))]:
            w[i] = np.median(frame)


def repair(profile: pd.DataFrame, params: Params, resolution: int) -> pd.DataFrame:
    """Weights of a whole profile (d, obs, possible)."""
    profile = profile.sort_values("d")
    possible, observed = profile["possible"].to_numpy(float).copy(), profile["obs"].to_numpy(float).copy()
    end = pool(possible, observed, params.possible_cutoff, params.observed_cutoff)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where((observed == 0) | (possible == 0), NAN, observed / possible)
    w[end:] = NAN
    if params.interpolate:
        smooth(w, params.quantile, -(-params.window // resolution))
    return pd.DataFrame({"d": profile["d"].to_numpy(), "w": w})


def repaired_weights(profile: DataFrame, params: Params, genome: Genome) -> DataFrame:
    """(d, w). One group: the profile has a row for each bin of the longest chromosome at
    most, whatever the input, and each step of the repair needs the one before."""
    resolution = genome.resolution
    ship(profile.sparkSession)
    return profile.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(lambda rows: repair(rows, params, resolution), "d long, w double")


def scaling_factors(weights: DataFrame, cis: DataFrame, genome: Genome) -> DataFrame:
    """(chrom, sf): expected over observed contacts of each chromosome; NaN without any, over full bins."""
    chroms = genome.table(cis.sparkSession)
    cells = chroms.where("full_bins > 0").select("chrom", "full_bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_bins") - 1)).alias("d"))
    term = F.when(finite(F.col("w")), (F.col("full_bins") - F.col("d")) * F.col("w")).otherwise(0.0)
    wanted = cells.join(maybe_broadcast(weights, genome.longest, 24), "d").groupBy("chrom").agg(F.sum(term).alias("wanted"))
    joined = chroms.select("chrom").join(sums_by_chrom(cis), "chrom", "left").join(wanted, "chrom", "left")
    return joined.select("chrom", F.when(F.col("cis_sum").isNull(), F.lit(NAN)).otherwise(ratio(F.coalesce("wanted", F.lit(0.0)), F.col("cis_sum"))).alias("sf"))


def trans_averages(trans: DataFrame, genome: Genome) -> DataFrame:
    """(chrom1, chrom2, avg) over non-zero cells of all pairs of different chromosomes."""
    pairs = genome.pair_table(trans.sparkSession, "trans").select(*PAIR)
    return pairs.join(nnz_average(totals(trans)), PAIR, "left").select(*PAIR, F.coalesce("avg", F.lit(0.0)).alias("avg"))


def trans_density(trans: DataFrame, genome: Genome) -> DataFrame:
    """(chrom1, chrom2, density): contacts over cells of full bins; 0 without cells."""
    sums = trans.groupBy(*PAIR).agg(F.sum("n").alias("n"))
    full = lambda c: genome.lookup(F.col(c), {n: genome.full_bins(n) for _, n, _ in genome.real})
    cells = full("chrom1") * full("chrom2")
    return sums.select(*PAIR, F.coalesce(F.try_divide(F.col("n").cast("double"), cells), F.lit(0.0)).alias("density"))


def expected_values(pixels: DataFrame, genome: Genome, params: Params, user_mask: DataFrame | None = None, kind: str = "all") -> Expected:
    """Expected values of a matrix. kind: all, cis or trans.

    Within chromosomes one profile serves the whole genome, even if one chromosome is asked for.
    """
    if kind == "trans":
        params = params.trans_only()
    # each part is used by those below: worked out once, and not again in every later scan
    mask = settle(bin_mask(scan_kind(pixels, kind), genome, params.mad_max, user_mask, kind), genome.side_rows(kind), "mask")
    weights = scaling = trans = None
    if kind != "trans":
        cis = usable(scan_kind(pixels, "cis"), genome, params.min_delta, params.max_delta, mask, settled=True)
        cis = settle(contacts_by_distance(cis), sum(map(genome.bins, genome.ids)), "distances")
        profile = settle(raw_profile(cis, genome), genome.longest, "profile")
        weights = settle(repaired_weights(profile, params, genome), genome.longest, "weights")
        scaling = settle(scaling_factors(weights, cis, genome), len(genome.chroms), "scaling")
    if kind != "cis":
        trans = usable(scan_kind(pixels, "trans"), genome, 0, params.max_delta, mask, settled=True)
        trans = settle(trans_averages(trans, genome), len(genome.pairs("trans")), "trans")
    return Expected(params, weights, scaling, trans, mask)


def with_expected(pixels: DataFrame, expected: Expected, genome: Genome) -> DataFrame:
    """pixels and ex, the value expected of each: w[b2-b1]/sf within a chromosome, else the pair's mean.

    A scaled weight that isn't finite is 0. The tables joined are bounded by the genome.
    """
    out = pixels
    own = F.lit(0.0)
    if expected.weights is not None:
        weights = expected.weights.select(F.col("d").alias("__d"), F.col("w").alias("__w"))
        scaling = expected.scaling.select(F.col("chrom").alias("chrom1"), F.col("sf").alias("__sf"))
        out = out.withColumn("__d", F.when(is_cis(), F.col("b2") - F.col("b1")))
        out = out.join(maybe_broadcast(weights, genome.longest, 24), "__d", "left").join(F.broadcast(scaling), "chrom1", "left")
        scaled = F.when(F.col("__sf") == 1, F.col("__w")).otherwise(ratio(F.col("__w"), F.col("__sf")))
        own = F.when(finite(scaled), scaled).otherwise(0.0)
    other = F.lit(0.0)
    if expected.trans is not None:
        averages = expected.trans.select(*PAIR, F.col("avg").alias("__avg"))
        out = out.join(maybe_broadcast(averages, len(genome.pairs("trans"))), PAIR, "left")
        other = F.coalesce("__avg", F.lit(0.0))
    return out.select(*[F.col(c) for c in pixels.columns], F.when(is_cis(), own).otherwise(other).alias("ex"))
