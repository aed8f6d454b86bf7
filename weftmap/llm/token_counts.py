"""Token counts: separator scan over flat, unindexed token files.

A flat file is ids one after the other, each document ended by a separator id, with no
index. It is kept as a table of fixed-size blocks, (file, block, ids as little-endian
unsigned 32-bit bytes), so any number of tasks can read one file; documents cross blocks.
Each block is searched for separators by one vectorised comparison. Only a summary of
each block (its separators, its length) goes through a prefix scan over the blocks of a
file; that gives the ordinal of the first document ending there and where it began, and
each block then knows the lengths of all documents that end in it.

Files written elsewhere come in by ``read_flat``, in byte ranges.

Defined cases: null text is an empty document (one separator); a file that doesn't end in
a separator has a last, open document, reported with closed = false; empty blocks and
files have no documents; repeated rows are documents of their own; a very long text is
tokenized in one task, with some twenty times its size in memory, and then cut into blocks
like any other; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, release, ship
from .words import mergeable, word_encoder

BLOCK_IDS = 1 << 16


def write_flat(docs: DataFrame, tokenizer: str, separator: int, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenize docs into flat files, one a partition; (blocks: file, block, ids; order: file, ordinal, doc_id).

    The separator's own string inside a text is ordinary text, so the id only ends documents.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(mergeable(tokenizer) or {})  # the vocabulary, some 50,000 tokens

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = word_encoder(tokenizer, True, shared.value), 4 * block_ids
        file, block, ordinal, rest = TaskContext.get().partitionId(), 0, 0, bytearray()
        names, kinds = ["file", "block", "ids", "ordinal", "doc_id"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        rows = lambda *columns: pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def blocks(some: list[bytes]) -> pa.RecordBatch:
            return rows([file] * len(some), range(block, block + len(some)), some, [None] * len(some), [None] * len(some))

        for batch in batches:
            for at, ids, bounds in encoder.encode_texts(batch.column(1), separator):
                n = len(bounds) - 1
                yield rows([file] * n, [None] * n, [None] * n, range(ordinal, ordinal + n), batch.column(0).slice(at, n))
                ordinal += n
                rest += ids.tobytes()
                done = len(rest) - len(rest) % size
                for k in range(0, done, size * 64):
                    some = [bytes(rest[x : x + size]) for x in range(k, min(done, k + size * 64), size)]
                    yield blocks(some)
                    block += len(some)
                del rest[:done]
        if rest:
            yield blocks([bytes(rest)])
        release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = materialise(chosen.mapInArrow(tokenize, "file long, block long, ids binary, ordinal long, doc_id long"), "flat")
    return both.where("block is not null").select("file", "block", "ids"), both.where("ordinal is not null").select("file", "ordinal", "doc_id")


def open_range(path: str, offset: int, length: int) -> bytes:
    """Bytes of a file in any store that Arrow reads."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return file.read_at(length, offset)


def read_flat(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, id_bytes: int = 4, read: Callable[[str, int, int], bytes] = open_range) -> DataFrame:
    """(file, path, block, ids) of flat token files under path, whose ids are little-endian and unsigned, 2 or 4 bytes each.

    Spark lists the files, without reading them; each block is a byte range that a task of
    its own may read, so one long file is read by many tasks. read(path, offset, length) is
    for stores that Arrow doesn't know. A length that isn't a whole number of ids raises.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    size = block_ids * id_bytes
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.select("path", "length", F.posexplode(starts).alias("block", "offset")).select("path", F.col("block").cast("long").alias("block"), "offset", F.least(F.lit(size), F.col("length") - F.col("offset")).alias("n"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = read(row["path"], row["offset"], row["n"])
                if len(data) != row["n"] or len(data) % id_bytes:
                    raise ValueError(f"{row['path']}: {len(data)} bytes at {row['offset']} instead of {row['n']}, in ids of {id_bytes}")
                ids = np.frombuffer(data, f"<u{id_bytes}").astype("<u4").tobytes()
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "block": row["block"], "ids": ids}], pa.schema([("path", pa.string()), ("block", pa.int64()), ("ids", pa.binary())]))

    # blocks of one file are dealt to all tasks
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism * 4)
    return dealt.mapInArrow(load, "path string, block long, ids binary").select(F.xxhash64("path").alias("file"), "path", "block", "ids")


def scan_separators(blocks: DataFrame, separator: int) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) for each document of flat files; n_tokens is without the separator.

    blocks: file, block, ids. Blocks are numbered from 0 without gaps and may differ in length.
    """
    ship(blocks.sparkSession)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, block, ids in zip(*batch.columns):
                found = np.frombuffer(ids.as_py(), "<u4")
                places = np.flatnonzero(found == separator)
                out.append((file.as_py(), block.as_py(), len(found), places.astype(np.int64).tobytes(), len(places), int(places[-1]) if len(places) else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "block", "n_ids", "places", "n_separators", "last_separator"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.frombuffer(row["places"], np.int64) + row["base"]
                starts = np.concatenate(([row["open_start"]], ends + 1))
                closed = np.ones(len(ends), bool)
                if row["is_last"] and starts[-1] < row["base"] + row["n_ids"]:
                    ends, closed = np.append(ends, row["base"] + row["n_ids"]), np.append(closed, False)
                starts = starts[: len(ends)]
                if len(ends):
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, row["file"])), pa.array(np.arange(n) + row["first"]), pa.array(starts), pa.array(ends - starts), pa.array(closed)],
                        ["file", "ordinal", "start", "n_tokens", "closed"],
                    )

    # kept, as the scan of what is before a block reads all summaries of its file
    found = materialise(blocks.select("file", "block", "ids").mapInArrow(summary, "file long, block long, n_ids long, places binary, n_separators long, last_separator long"), "separators")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    sized = found.select("file", "block", "n_ids", "n_separators", "last_separator")
    scanned = sized.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    scanned = scanned.select(
        "file", "block", "base",
        F.coalesce(F.sum("n_separators").over(before), F.lit(0)).alias("first"),
        F.coalesce(F.max(F.col("base") + F.col("last_separator") + 1).over(before), F.lit(0)).alias("open_start"),
        F.lead("block").over(order).isNull().alias("is_last"),
    )
    joined = found.select("file", "block", "n_ids", "places").join(scanned, ["file", "block"])
    return joined.mapInArrow(stitch, "file long, ordinal long, start long, n_tokens long, closed boolean")


def count_tokens(docs: DataFrame, tokenizer: str, separator: int, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): flat files of docs, scanned and named again by their order."""
    blocks, order = write_flat(docs, tokenizer, separator, block_ids, id_col, text_col)
    counts = scan_separators(blocks, separator)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
