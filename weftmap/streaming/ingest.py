"""Contacts that arrive over time, summed up to a pixel table.

Matrices are bounded in every other module; this one only keeps their input up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Genome

KEY = ["chrom1", "chrom2", "b1", "b2"]


def contacts_to_pixels(contacts: DataFrame, genome: Genome) -> DataFrame:
    """Pixels of contacts (chrom1, pos1, chrom2, pos2), each laid into the upper triangle."""
    r = genome.resolution
    known = contacts.where(F.col("chrom1").isin(*genome.ids) & F.col("chrom2").isin(*genome.ids))
    end = lambda k: F.struct(genome.id_of(F.col(f"chrom{k}")).alias("id"), F.floor(F.col(f"pos{k}") / r).alias("b"), F.col(f"chrom{k}").alias("chrom"))
    ordered = known.select(F.least(end(1), end(2)).alias("x"), F.greatest(end(1), end(2)).alias("y"))
    return ordered.groupBy(F.col("x.chrom").alias("chrom1"), F.col("y.chrom").alias("chrom2"), F.col("x.b").alias("b1"), F.col("y.b").alias("b2")).agg(F.count(F.lit(1)).alias("n"))


def ingest(contacts: DataFrame, genome: Genome, path: str, checkpoint: str):
    """Start a query that appends each micro-batch's pixels to path/batch=N.

    A batch that is run again after a failure replaces what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        contacts_to_pixels(batch, genome).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return contacts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current_pixels(parts: DataFrame) -> DataFrame:
    """The pixel table of all batches so far."""
    return parts.groupBy(*KEY).agg(F.sum("n").alias("n"))
