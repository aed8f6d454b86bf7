"""Pixel tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Genome
from ..operators.pixels import from_thin


def read_pixels(spark: SparkSession, path: str, genome: Genome) -> DataFrame:
    """Pixels of a Parquet table: chrom1, chrom2, b1, b2, n, or thin (bin1_id, bin2_id, count).

    Unsigned 64-bit counts, which Spark reads as decimals, become longs.
    """
    rows = spark.read.parquet(path)
    if {"bin1_id", "bin2_id", "count"} <= set(rows.columns):
        rows = from_thin(rows, genome)
    kinds = dict(rows.dtypes)
    if missing := {"chrom1", "chrom2", "b1", "b2", "n"} - set(kinds):
        raise ValueError(f"{path} has no {', '.join(sorted(missing))}")
    n = F.col("n").cast("long") if kinds["n"].startswith("decimal") or kinds["n"] in ("int", "smallint", "tinyint") else F.col("n")
    return rows.select("chrom1", "chrom2", F.col("b1").cast("long").alias("b1"), F.col("b2").cast("long").alias("b2"), n.alias("n"))


def read_pixel_text(spark: SparkSession, path: str, genome: Genome) -> DataFrame:
    """Pixels of text as matrix tools dump them: tab-separated chrom1 start1 end1 chrom2 start2 end2 count,
    or chrom1 start1 chrom2 start2 count; gzip too. Lines of the lower triangle are turned over, those on
    unknown chromosomes left out, a pixel met twice is summed; a line of another form raises.
    """
    fields = F.split(F.regexp_replace("value", r"\r+$", ""), "\t")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", fields.alias("f"))
    wide, narrow = F.size("f") == 7, F.size("f") == 5
    at = lambda w, k: F.when(wide, F.get("f", F.lit(w))).when(narrow, F.get("f", F.lit(k))).otherwise(F.raise_error(F.concat(F.lit("not a pixel: "), F.col("value"))).cast("string"))
    number = lambda c, kind: F.coalesce(c.try_cast(kind), F.raise_error(F.concat(F.lit("not a number: "), c)).cast(kind))
    r = F.lit(genome.resolution)
    one = lambda c, s: F.struct(genome.id_of(c).alias("id"), F.floor(number(s, "bigint") / r).alias("b"), c.alias("chrom"))
    count = F.get("f", F.size("f") - 1)
    rows = lines.select(one(at(0, 0), at(1, 1)).alias("x"), one(at(3, 2), at(4, 3)).alias("y"), number(count, "double").alias("n")).where("x.id is not null and y.id is not null")
    ordered = rows.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n")
    summed = ordered.groupBy(F.col("x.chrom").alias("chrom1"), F.col("y.chrom").alias("chrom2"), F.col("x.b").alias("b1"), F.col("y.b").alias("b2")).agg(F.sum("n").alias("n"))
    whole = F.col("n") == F.floor("n")
    return summed.withColumn("n", F.when(whole, F.col("n").cast("long")).otherwise(F.raise_error(F.lit("counts must be whole numbers")).cast("long")))


def write_pixels(pixels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """By pair of chromosomes, sorted by bins: scans of a pair or a range read what they need."""
    pixels.repartition("chrom1", "chrom2", F.floor(F.col("b1") / 4096)).sortWithinPartitions("chrom1", "chrom2", "b1", "b2").write.mode(mode).partitionBy("chrom1", "chrom2").parquet(path)


def is_empty(pixels: DataFrame) -> bool:
    return pixels.isEmpty()
