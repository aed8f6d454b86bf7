"""Genomes, parameters and the schemas that results keep."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No upper limit of the distance.
UNBOUNDED = 2**63 - 1
#: Sides below this many bytes, by a bound known before the query runs, are broadcast.
BROADCAST_BYTES = 64 << 20

COMPUTE_COLUMNS = ("chrom1", "start1", "end1", "chrom2", "start2", "end2", "pvalue", "observed_count", "expected_count", "log_ratio", "odds_ratio", "omega")
FILTER_COLUMNS = (*COMPUTE_COLUMNS[:7], "pvalue_corrected", *COMPUTE_COLUMNS[7:])
COORDINATES = COMPUTE_COLUMNS[:6]
TYPES = {"chrom1": "string", "chrom2": "string"} | {c: "bigint" for c in ("start1", "end1", "start2", "end2", "observed_count")}


def ddl(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{c} {TYPES.get(c, 'double')}" for c in columns)


@dataclass(frozen=True)
class Genome:
    """Chromosomes in order of their ids, and the width of a bin.

    A pseudo-chromosome named "All" keeps its id, but takes no part in anything.
    """

    chroms: tuple[tuple[str, int], ...]
    resolution: int

    def __post_init__(self) -> None:
        if self.resolution <= 0:
            raise ValueError("resolution must be positive")
        if len({n for n, _ in self.chroms}) != len(self.chroms):
            raise ValueError("chromosome names must be unique")

    @property
    def real(self) -> list[tuple[int, str, int]]:
        """(id, name, size) without the pseudo-chromosome."""
        return [(i, n, s) for i, (n, s) in enumerate(self.chroms) if n.lower() != "all"]

    @property
    def sizes(self) -> dict[str, int]:
        return {n: s for _, n, s in self.real}

    @property
    def ids(self) -> dict[str, int]:
        return {n: i for i, n, _ in self.real}

    def bins(self, chrom: str) -> int:
        """Bins of a chromosome, a partial last one included."""
        return -(-self.sizes[chrom] // self.resolution)

    def full_bins(self, chrom: str) -> int:
        """Bins of full width."""
        return self.sizes[chrom] // self.resolution

    @property
    def longest(self) -> int:
        """Bins of the longest chromosome."""
        return max((self.bins(n) for _, n, _ in self.real), default=0)

    def pairs(self, kind: str = "all") -> list[tuple[str, str]]:
        """Pairs of the upper triangle, by id. kind: all, cis or trans."""
        names = [n for _, n, _ in self.real]
        found = [(a, b) for k, a in enumerate(names) for b in names[k:]]
        return [(a, b) for a, b in found if kind == "all" or (a == b) == (kind == "cis")]

    def table(self, spark: SparkSession) -> DataFrame:
        """chrom_id, chrom, size, bins, full_bins."""
        rows = [(i, n, s, self.bins(n), self.full_bins(n)) for i, n, s in self.real]
        return spark.createDataFrame(rows, "chrom_id int, chrom string, size bigint, bins bigint, full_bins bigint")

    def pair_table(self, spark: SparkSession, kind: str = "all") -> DataFrame:
        """chrom1, chrom2, id1, id2, size1, size2, bins1, bins2, one row a pair of the upper triangle."""
        rows = [(a, b, self.ids[a], self.ids[b], self.sizes[a], self.sizes[b], self.bins(a), self.bins(b)) for a, b in self.pairs(kind)]
        return spark.createDataFrame(rows, "chrom1 string, chrom2 string, id1 int, id2 int, size1 bigint, size2 bigint, bins1 bigint, bins2 bigint")

    def bin_table(self, spark: SparkSession) -> DataFrame:
        """chrom, b, bin_id, start, end: all bins; bin_id counts over the whole genome."""
        offsets, at = {}, 0
        for _, n, _ in self.real:
            offsets[n] = at
            at += self.bins(n)
        rows = self.table(spark).where("bins > 0").select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("b"))
        offset = self.lookup(F.col("chrom"), offsets)
        r = F.lit(self.resolution)
        return rows.select("chrom", "b", (offset + F.col("b")).alias("bin_id"), (F.col("b") * r).alias("start"), F.least((F.col("b") + 1) * r, F.col("size")).alias("end"))

    def lookup(self, chrom, values: dict[str, int]):
        """A value for each chromosome name, as a column; null for other names."""
        if not values:
            return F.lit(None).cast("long")
        out = F
        for name, value in values.items():
            out = out.when(chrom == name, F.lit(value).cast("long"))
        return out

    def id_of(self, chrom):
        return self.lookup(chrom, self.ids)

    def size_of(self, chrom):
        return self.lookup(chrom, self.sizes)

    def side_rows(self, kind: str = "all") -> int:
        """The most rows that a table of bins by pair and side can have."""
        return sum(self.bins(a) + (self.bins(b) if a != b else 0) for a, b in self.pairs(kind))


def maybe_broadcast(df: DataFrame, most_rows: int, row_bytes: int = 64, settled: bool = False) -> DataFrame:
    """df, to be broadcast if its proven largest size allows, or if it is settled and its count does; else the planner decides."""
    allowed = BROADCAST_BYTES // row_bytes
    small = most_rows <= allowed or (settled and df.limit(allowed + 1).count() <= allowed)
    return F.broadcast(df) if small else df


@dataclass(frozen=True)
class Params:
    """What expected values depend on. The defaults are those of the compute command."""

    mad_max: float = 5.0
    min_delta: int = 40_000
    max_delta: int = UNBOUNDED
    possible_cutoff: float = 0.0
    observed_cutoff: float = 5_000.0
    interpolate: bool = True
    quantile: float = 0.975
    window: int = 750_000

    def __post_init__(self) -> None:
        if self.mad_max < 0 or not math.isfinite(self.mad_max):
            raise ValueError("mad_max should be a non-negative value")
        if self.min_delta > self.max_delta:
            raise ValueError("min_delta should be less than or equal to max_delta")
        if not 0 <= self.quantile <= 1:
            raise ValueError("quantile should be between 0 and 1")

    @classmethod
    def library(cls, **more) -> Params:
        """Cut-offs as used by the library's own interface."""
        return cls(**{"possible_cutoff": 10_000.0, "observed_cutoff": 100_000.0} | more)

    @classmethod
    def expected_command(cls, **more) -> Params:
        return cls(**{"possible_cutoff": 1_000.0, "observed_cutoff": 100_000.0} | more)

    def trans_only(self) -> Params:
        """All but the mask's parameter at rest."""
        return replace(self, min_delta=0, max_delta=UNBOUNDED, possible_cutoff=0.0, observed_cutoff=0.0, interpolate=False, quantile=0.0, window=0)
