"""merge: many results become one, in genome order."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import Genome
from ..operators.domains import linear_order
from ..sources.results import check_compatible, read_results, record_type


def merge_results(tables: list[DataFrame], genome: Genome, sort: bool = True) -> DataFrame:
    """UNION ALL of results of one record type, ordered by chromosome ids and coordinates."""
    if len({record_type(t) for t in tables}) != 1:
        raise ValueError("results to be merged must be of one record type")
    together = reduce(DataFrame.unionByName, tables)
    return together.orderBy(*linear_order(genome)) if sort else together


def merge_files(spark: SparkSession, paths: list[str], genome: Genome, sort: bool = True) -> DataFrame:
    """The same for files; they are read as one table, so their number doesn't deepen the plan.

    Single files are held against each other first: record type and chromosomes.
    """
    check_compatible([p for p in paths if Path(p).is_file()])
    rows = read_results(spark, paths)
    return rows.orderBy(*linear_order(genome)) if sort else rows
