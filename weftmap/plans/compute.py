"""compute: a p-value for each pixel, or for each domain.

One plan for all pairs of chromosomes. The pixels are scanned four times: for the masks,
for the expected values (those of one chromosome for the profile, the others for means),
for all marginals and totals (observed and expected together), and for the test. What a scan
gathers is bounded by the genome, not by the pixels; it is worked out once, and then
joined to the next scan. Only the last scan is left to the caller's action.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fnch import INT32, fnch_tail
from ..functions.stats import finite, significance
from ..model import COMPUTE_COLUMNS, UNBOUNDED, Genome, Params, maybe_broadcast
from ..operators.domains import domain_marginals, overlap_sums
from ..operators.expected import Expected, expected_values, with_expected
from ..operators.marginals import PAIR, marginals, totals_of_marginals
from ..operators.pixels import is_cis, scan_kind, usable, with_coordinates
from ..scratch import settle, ship


def tested(rows: DataFrame, kernel=None) -> DataFrame:
    """pvalue, odds_ratio, omega and log_ratio from n, ex, total, n1, n2, exp_total, l1, l2.

    Only rows that need the kernel reach it with values; the others have p = 1.
    """
    found = significance(F.col("n"), F.col("ex"), is_cis(), F.col("total"), F.col("n1"), F.col("n2"), F.col("exp_total"), F.col("l1"), F.col("l2"))
    rows = rows.withColumns(found)
    ship(rows.sparkSession)
    # a row that isn't tested passes nulls to the kernel, which skips it
    only = lambda c: F.when(F.col("tested"), F.col(c).cast("long"))
    tail = (kernel or fnch_tail)(only("n"), only("n1"), only("n2"), only("total"), F.when(F.col("tested"), F.col("omega")))
    too_large = F.col("tested") & (F.greatest("n1", "n2", "total") > INT32)
    rows = rows.where(F.when(too_large, F.raise_error(F.lit("margins beyond 2^31-1 can't be tested")).cast("boolean")).otherwise(True))
    return rows.withColumn("pvalue", F.coalesce(tail, F.lit(1.0)))


def valid() -> Column:
    """Rows worth keeping: a finite odds ratio and an omega that isn't 0."""
    return finite(F.col("odds_ratio")) & (F.col("omega") != 0)


def output(rows: DataFrame) -> DataFrame:
    return rows.select(*COMPUTE_COLUMNS[:6], "pvalue", F.col("n").cast("long").alias("observed_count"), F.col("ex").alias("expected_count"), "log_ratio", "odds_ratio", "omega")


def _margins(pixels: DataFrame, expected: Expected, genome: Genome) -> DataFrame:
    """Marginals of observed (m) and expected (lm) contacts; expected ones between chromosomes are the contacts."""
    valued = with_expected(pixels, expected, genome).withColumn("lx", F.when(is_cis(), F.col("ex")).otherwise(F.col("n").cast("double")))
    return settle(marginals(valued, m="n", lm="lx"), genome.side_rows(), "marginals")


def compute(
    pixels: DataFrame,
    genome: Genome,
    params: Params | None = None,
    expected: Expected | None = None,
    user_mask: DataFrame | None = None,
    kind: str = "all",
    kernel=None,
) -> DataFrame:
    """A row for each usable pixel that can be tested; see COMPUTE_COLUMNS. kind: all, cis or trans.

    expected: as stored; else it is made from the pixels with params.
    """
    pixels = scan_kind(pixels, kind)
    expected = expected or expected_values(pixels, genome, params or Params(), user_mask, kind)
    params = params or expected.params
    used = usable(pixels, genome, params.min_delta, params.max_delta, expected.mask, settled=True)
    margins = _margins(used, expected, genome)
    sums = totals_of_marginals(margins, total="m", exp_total="lm")
    most = genome.side_rows(kind)
    first = margins.where("side = 1").select(*PAIR, F.col("b").alias("b1"), F.col("m").alias("n1"), F.col("lm").alias("l1"))
    second = margins.where((F.col("side") == 2) | is_cis()).select(*PAIR, F.col("b").alias("b2"), F.col("m").alias("n2"), F.col("lm").alias("l2"))
    joined = with_expected(used, expected, genome)
    joined = joined.join(maybe_broadcast(first, most), [*PAIR, "b1"]).join(maybe_broadcast(second, most), [*PAIR, "b2"])
    joined = joined.join(maybe_broadcast(sums, len(genome.pairs(kind))), PAIR)
    return output(tested(with_coordinates(joined, genome), kernel).where(valid()))


def compute_domains(
    pixels: DataFrame,
    domains: DataFrame,
    genome: Genome,
    params: Params | None = None,
    expected: Expected | None = None,
    user_mask: DataFrame | None = None,
    bad_bin_fraction: float = 0.1,
    kind: str = "all",
    kernel=None,
) -> DataFrame:
    """A row for each domain that can be tested.

    A domain one of whose sides has at least bad_bin_fraction masked bins has no
    contacts, and so, as those without any contact, isn't in the result.
    """
    if not 0 <= bad_bin_fraction <= 1:
        raise ValueError("bad_bin_fraction should be between 0 and 1")
    pixels, domains = scan_kind(pixels, kind), scan_kind(domains, kind)
    expected = expected or expected_values(pixels, genome, params or Params(), user_mask, kind)
    params = params or expected.params
    used = usable(pixels, genome, params.min_delta, params.max_delta, expected.mask, settled=True)
    margins = _margins(used, expected, genome)
    sums = totals_of_marginals(margins, total="m", exp_total="lm")
    counted = overlap_sums(with_expected(used, expected, genome), domains, genome, n="n", ex="ex")
    sided = domain_marginals(counted, margins, expected.mask, genome, kind)
    good = (F.col("bad1") < bad_bin_fraction) & (F.col("bad2") < bad_bin_fraction)
    rows = sided.withColumns({"n": F.when(good, F.col("n")).otherwise(0).cast("long"), "ex": F.when(good, F.col("ex")).otherwise(0.0).cast("double")})
    rows = rows.join(maybe_broadcast(sums, len(genome.pairs(kind))), PAIR, "left")
    return output(tested(rows, kernel).where(valid()))


def expected_only(pixels: DataFrame, genome: Genome, params: Params | None = None, user_mask: DataFrame | None = None, kind: str = "all", pair: tuple[str, str] | None = None) -> Expected:
    """The expected command. pair: one sub-matrix; within a chromosome it still has the whole genome's profile."""
    params = params or Params.expected_command()
    if pair and pair[0] != pair[1]:
        params = replace(params, min_delta=0, max_delta=UNBOUNDED)
        pixels = pixels.where((F.col("chrom1") == pair[0]) & (F.col("chrom2") == pair[1]))
        return expected_values(pixels, genome, params, user_mask, "trans")
    return expected_values(pixels, genome, params, user_mask, "cis" if pair else kind)
