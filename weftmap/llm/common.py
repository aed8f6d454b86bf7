"""Helpers shared by the operators: shared scratch tables, row locators, shipping code."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialise, scratch  # noqa: F401  the operators take these from here
from ..scratch import ship as ship_package

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python at once, where the session doesn't say: whole texts may be long.
ARROW_ROWS = "1024"


def ship(spark: SparkSession) -> None:
    """Get Python workers ready: small batches, and this package where PYTHONPATH doesn't already have it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    ship_package(spark)


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What make() gives, kept by a worker process between tasks until another operator's tables are asked for.

    Workers outlive a pipeline's stages, so what one stage leaves behind is memory the next lacks.
    """
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def file_backed(docs: DataFrame) -> DataFrame:
    """docs, if its rows come from files and so have a place; else docs written out and read again.

    Steps that locate rows of one DataFrame more than once begin with this.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except Exception as error:  # noqa: BLE001  Spark raises several kinds of analysis errors here
        if "_metadata" not in str(error):
            raise
    return materialise(docs, "rows")


def with_locator(docs: DataFrame, prefix: str = "__wm_") -> DataFrame:
    """Add a locator of each row, (hash of its file's path, row in that file).

    It names a physical row, also among repeated rows, and is the same whenever
    the row is read again. Data that isn't in Parquet files is written out first.
    """
    return file_backed(docs).select("*", F.xxhash64("_metadata.file_path").alias(f"{prefix}file"), F.col("_metadata.row_index").alias(f"{prefix}row"))


#: Keys of fewer rows are never treated apart, and at most so many are.
HOT_ROWS, HOT_KEYS = 1024, 50_000


def hot_bound(total: int, hot_rows: int = HOT_ROWS) -> int:
    """From how many rows on a key is hot, among total rows: at most HOT_KEYS keys can be."""
    return max(2, hot_rows, total // HOT_KEYS)


def join_sized(rows: DataFrame, sized: DataFrame, key: str, bound: int, n: str = "n") -> DataFrame:
    """rows with the columns of sized, which has a row for each key and in n the number of rows that have it.

    Hot keys, those of bound rows or more, are few and broadcast; so no task gets more
    than bound rows of one key. rows should be cheap to read twice.
    """
    hot, cold = F.broadcast(sized.where(F.col(n) >= bound)), sized.where(F.col(n) < bound)
    rest = rows.join(F.broadcast(sized.where(F.col(n) >= bound).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def drop_rows(docs: DataFrame, dropped: DataFrame, filter_bytes: int = 4 << 20) -> DataFrame:
    """docs, backed by files, without the rows whose locators are in dropped (columns __wm_file, __wm_row).

    A Bloom filter of at most filter_bytes lets rows that surely stay go on without being
    moved; the others, those dropped and its false positives, meet dropped in a join.
    """
    from .bloom import in_level, prefilter

    place = F.xxhash64("__wm_file", "__wm_row")
    keys = materialise(dropped.select("__wm_file", "__wm_row"), "dropped")
    maybe = in_level(place, prefilter(keys.select(place.alias("key")), filter_bytes))
    located = with_locator(docs)
    doubtful = located.where(maybe).join(keys, ["__wm_file", "__wm_row"], "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return located.where(~maybe).select(*columns).union(doubtful.select(*columns))


def pick_rows(located: DataFrame, wanted: DataFrame, filter_bytes: int = 4 << 20) -> DataFrame:
    """The rows of located, with a locator, that wanted names by theirs, and wanted's columns; wanted is written before.

    A Bloom filter keeps rows that surely aren't wanted from being moved.
    """
    from .bloom import in_level, prefilter

    place = F.xxhash64("__wm_file", "__wm_row")
    maybe = in_level(place, prefilter(wanted.select(place.alias("key")), filter_bytes))
    return located.where(maybe).join(wanted, ["__wm_file", "__wm_row"])


def let(value, body):
    """body(value) with value evaluated once a row, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
