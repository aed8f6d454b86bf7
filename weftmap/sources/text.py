"""Text formats: BED3, BEDPE, chrom.sizes, bin masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_fields
from ..model import COORDINATES, Genome
from ..operators.domains import select_chroms
from ..scratch import ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, and their place in the file."""
    rows = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("line"))
    return rows.where(F.trim(F.regexp_replace("value", r"\r", "")) != "")


def _number(field: Column, name: str) -> Column:
    return F.when(field.rlike(r"^\d+$"), field.cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{name} isn't a number: "), field)).cast("long"))


def _fields(lines: DataFrame, n: int) -> DataFrame:
    found = first_fields(F.col("value"), n)
    return lines.select("line", F.coalesce(found, F.raise_error(F.concat(F.lit(f"fewer than {n} fields: "), F.col("value"))).cast("array<string>")).alias("f"))


def read_bed3(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, line) of the first three fields of each line."""
    rows = _fields(_lines(spark, path), 3)
    return rows.select(F.col("f")[0].alias("chrom"), _number(F.col("f")[1], "start").alias("start"), _number(F.col("f")[2], "end").alias("end"), "line")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    """(chrom1 ... end2) of the first six fields."""
    rows = _fields(_lines(spark, path), 6)
    one = lambda k, name: F.col("f")[k].alias(name) if name.startswith("chrom") else _number(F.col("f")[k], name).alias(name)
    return rows.select(*[one(k, name) for k, name in enumerate(COORDINATES)])


@dataclass(frozen=True)
class Drops:
    """How many rectangles were read, and dropped for which reason."""

    parsed: int
    unknown_chrom: int
    wrong_kind: int
    not_selected: int
    duplicates: int


def domains_of(rectangles: DataFrame, genome: Genome, keep_cis: bool = True, keep_trans: bool = True, chrom1: str | None = None, chrom2: str | None = None) -> DataFrame:
    """Distinct rectangles that a run is about; one of the lower triangle is an error."""
    known = rectangles.where(F.col("chrom1").isin(*genome.ids) & F.col("chrom2").isin(*genome.ids))
    own = F.col("chrom1") == F.col("chrom2")
    kept = known.where((own & F.lit(keep_cis)) | (~own & F.lit(keep_trans)))
    id1, id2 = genome.id_of(F.col("chrom1")), genome.id_of(F.col("chrom2"))
    lower = (id1 > id2) | (own & (F.struct("start1", "end1") > F.struct("start2", "end2")))
    text = F.concat_ws(" ", *COORDINATES)
    checked = kept.where(F.when(lower, F.raise_error(F.concat(F.lit("not in the upper triangle: "), text)).cast("boolean")).otherwise(True))
    return select_chroms(checked, chrom1, chrom2).distinct()


def count_drops(rectangles: DataFrame, genome: Genome, keep_cis: bool = True, keep_trans: bool = True, chrom1: str | None = None, chrom2: str | None = None) -> Drops:
    """One aggregation of all reasons; raises if nothing is left."""
    known = F.col("chrom1").isin(*genome.ids) & F.col("chrom2").isin(*genome.ids)
    own = F.col("chrom1") == F.col("chrom2")
    right = (own & F.lit(keep_cis)) | (~own & F.lit(keep_trans))
    chosen = F.lit(True) if chrom1 is None else (F.col("chrom1") == chrom1) & (F.col("chrom2") == (chrom2 or chrom1))
    row = rectangles.agg(
        F.count(F.lit(1)).alias("parsed"),
        F.count(F.when(~known, 1)).alias("unknown"),
        F.count(F.when(known & ~right, 1)).alias("kind"),
        F.count(F.when(known & right & ~chosen, 1)).alias("chosen"),
        F.count(F.when(known & right & chosen, 1)).alias("left"),
        F.count_distinct(F.when(known & right & chosen, F.struct(*COORDINATES))).alias("distinct"),
    ).first()
    if not row["distinct"]:
        raise ValueError("no domain is left")
    return Drops(row["parsed"], row["unknown"], row["kind"], row["chosen"], row["left"] - row["distinct"])


def mask_bins(intervals: DataFrame, genome: Genome) -> DataFrame:
    """(chrom, b): bins of intervals, from start to end, that of the end included, up to the last one of the chromosome."""
    r = genome.resolution
    known = intervals.where(F.col("chrom").isin(*genome.ids))
    last = genome.lookup(F.col("chrom"), {n: genome.bins(n) - 1 for n in genome.ids})
    spans = known.select("chrom", F.floor(F.col("start") / r).alias("lo"), F.least(F.floor(F.col("end") / r), last).alias("hi")).where("lo <= hi")
    return spans.select("chrom", F.explode(F.sequence("lo", "hi")).alias("b")).distinct()


def read_chrom_sizes(spark: SparkSession, path: str, resolution: int = 1) -> Genome:
    """Chromosomes in the file's order. A row for each comes to the driver."""
    rows = _fields(_lines(spark, path), 2).select("line", F.col("f")[0].alias("name"), _number(F.col("f")[1], "size").alias("size")).orderBy("line").collect()
    return Genome(tuple((r["name"], r["size"]) for r in rows), resolution)


def two_chroms(chrom1: str, chrom2: str | None = None, resolution: int = 1) -> Genome:
    """A stand-in genome when only names are given."""
    return Genome(tuple((n, 2**31 - 1) for n in dict.fromkeys((chrom1, chrom2 or chrom1))), resolution)


def chrom_sizes_text(genome: Genome) -> str:
    return "".join(f"{n}\t{s}\n" for _, n, s in genome.real)


def scrape_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log at warning level or above."""
    return spark.read.text(path).where(F.col("value").rlike(r"\[(warning|error|critical)\]"))


def write_tsv(rows: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def tsv_lines(rows: DataFrame) -> DataFrame:
    """A column "line" with tab-separated values, doubles to six significant digits."""
    ship(rows.sparkSession)
    text = [F.format_string("%s", F.col(c)) if kind != "double" else short_double(F.col(c)) for c, kind in rows.dtypes]
    return rows.select(F.concat_ws("\t", *text).alias("line"))


def _short(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else "%g" % x for x in batch.to_pylist()], pa.string())


def short_double(x: Column) -> Column:
    """At most six significant digits without trailing zeros, as C's %g; Java's own differs."""
    return F.arrow_udf(_short, T.StringType())(x)
