"""Exact deduplication with stateful streaming.

Rows become small records: digest of the normalised text, its length, the stable id and a
locator of the row. A streaming query runs over the records with keyed state on disk
(RocksDB), without watermark or expiry: for each digest the number of rows, and length,
id and locator of the best row so far. Each micro-batch is aggregated by digest before it
is shuffled, so a digest that a third of the rows share costs one record a task. New
micro-batches go on from the same state.

Digests that hold more than one row are hits: the normalised bytes of each such row are
compared with those of the best row, found by its locator. Only their texts are moved,
picked by a Bloom filter of bounded size. Rows that differ (a digest collision) are
grouped again by their whole text.

Defined cases: null text counts as empty; of equal texts the row with the most code
points, then the smallest doc_id (null last), then the first locator stays, so of wholly
equal rows exactly one is kept; a very long text is compared like any other, as one value;
an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import MAX_BYTES, in_level, prefilter
from .common import HOT_ROWS, hot_bound, join_sized, materialise, scratch, with_locator

#: State on disk; without files allocated ahead, which would cost 4 MB for each partition of the state, and with
#: caches and buffers of all partitions of an executor bounded together.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def records(located: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, length, file, row) of rows with a locator."""
    return located.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(normalised(F.col(text_col))).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"),
        F.col("__wm_file").alias("file"),
        F.col("__wm_row").alias("row"),
    )


def best_row() -> Column:
    """Order of preference among equal texts, as a struct of which the least is best."""
    return F.struct((-F.col("length")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def stream_states(spark: SparkSession, source: DataFrame, checkpoint: str, out: str) -> None:
    """Run the stateful query over a streaming DataFrame of records until it has read all there is.

    Each micro-batch writes the states it changed to out/batch=N. Called again with the
    same checkpoint, it goes on with what has come since.
    """
    states = source.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best_row()).alias("best"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def latest_states(spark: SparkSession, out: str) -> DataFrame:
    """(digest, n, best): the last state written for each digest."""
    written = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return written.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("s")).select("digest", "s.n", "s.best")


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 10_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def collisions(located: DataFrame, states: DataFrame, hot: DataFrame, hot_rows: int, digest: Callable[[Column], Column], id_col: str, text_col: str, filter_bytes: int) -> DataFrame:
    """(digest, norm, doc_id, length, file, row) of the rows whose normalised bytes aren't those of their digest's best row.

    A Bloom filter of the digests held by more than one row picks the texts that are moved;
    what it lets through by mistake has no best row to meet. A digest of many rows is dealt
    with as many salts as it has hot_rows, each of which gets a copy of the best text.
    """
    hits = states.where("n > 1")
    maybe = in_level(F.col("digest"), prefilter(hits.select(F.col("digest").alias("key")), filter_bytes))
    text = located.select(
        F.col("__wm_file").alias("file"),
        F.col("__wm_row").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"),
    )
    some = materialise(text.withColumn("digest", digest(F.col("norm"))).where(maybe), "dedup-hits")
    parts = lambda n: F.ceil(n / F.lit(hot_rows)).cast("int")
    salted = some.join(F.broadcast(hot.select("digest", F.col("n").alias("hot_n"))), "digest", "left")
    salted = salted.withColumn("salt", F.when(F.col("hot_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("file", "row"), parts(F.col("hot_n"))).cast("int"))).drop("hot_n")
    is_hot = F.col("n") >= hot_rows
    where_best = hits.select("digest", "n", F.col("best.file").alias("file"), F.col("best.row").alias("row"))
    best = some.select("file", "row", "norm").join(where_best, ["file", "row"])
    best = best.select("digest", F.col("norm").alias("best_norm"), F.explode(F.when(is_hot, F.sequence(F.lit(0), parts(F.col("n")) - 1)).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = salted.join(best, ["digest", "salt"]).where("norm <> best_norm")
    return met.select("digest", "norm", "doc_id", "length", "file", "row")


def known_files(spark: SparkSession, path: str) -> DataFrame | None:
    """The files whose rows are on record, a long each; None if there is no record yet."""
    try:
        return spark.read.parquet(path).select("file").distinct()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def exact_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = 10_000,
    hot_rows: int = HOT_ROWS,
    filter_bytes: int = MAX_BYTES,
    state: str | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, __wm_file, __wm_row): a row for each row of docs.

    digest: of a normalised text; any one gives right groups, as hits are compared in full.
    A digest of hot_rows rows, or a 50,000th of all, whichever is more, isn't dealt by its
    key alone; there are 50,000 of them at most, which bounds what is broadcast.

    state: a folder, in the shared one, in which records and state outlive the call. Called
    again with it and with docs to which files have been added, only the rows of these are
    hashed, and the stream goes on; the groups are those of all rows.
    """
    spark = docs.sparkSession
    located = with_locator(docs.select(id_col, text_col))
    path = f"{state}/records" if state else scratch(spark, "dedup-records")
    all_rows = records(located, digest, id_col, text_col)
    known = known_files(spark, path) if state else None
    if known is not None:
        all_rows = all_rows.join(F.broadcast(known), "file", "left_anti").select(*all_rows.columns)
    all_rows.write.mode("append").parquet(path)
    rows = spark.read.schema(all_rows.schema).parquet(path)
    total = rows.count()
    if not total:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.col("file").alias("__wm_file"), F.col("row").alias("__wm_row"))
    out, checkpoint = (f"{state}/states", f"{state}/checkpoint") if state else (scratch(spark, "dedup-states"), scratch(spark, "dedup-stream"))
    stream_states(spark, read_stream(spark, path, all_rows.schema, files_per_batch), checkpoint, out)
    states = materialise(latest_states(spark, out), "dedup-final")
    hot_rows = hot_bound(total, hot_rows)
    hot = states.where(F.col("n") >= hot_rows)
    differing = materialise(collisions(located, states, hot, hot_rows, digest, id_col, text_col, filter_bytes), "dedup-collisions")

    result = join_sized(rows, states, "digest", hot_rows)
    if differing.isEmpty():
        chosen = result.select("*", F.col("n").alias("group_size"))
    else:
        strays = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("strays"))
        regrouped = differing.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n2"), F.min(best_row()).alias("best2"))
        moved = differing.join(regrouped, ["digest", "norm"]).select("file", "row", "n2", "best2")
        both = result.join(strays, "digest", "left").join(moved, ["file", "row"], "left")
        size = F.coalesce("n2", F.col("n") - F.coalesce("strays", F.lit(0)))
        chosen = both.select("doc_id", "digest", "file", "row", F.coalesce("best2", "best").alias("best"), size.alias("group_size"))
    return chosen.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest",
        F.col("file").alias("__wm_file"),
        F.col("row").alias("__wm_row"),
    )
