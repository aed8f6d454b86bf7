"""Packing: power-of-two decomposition.

A document's ids, with an end id, are cut from the front into pieces whose lengths are
powers of two: full sequences first, then the binary digits of what is left, the longest
first. Each piece is a sequence of its own; pieces of one length form a bucket, from
which ``batches`` draws batches of equal length. No sequence crosses documents and none
is padded.

Defined cases: null text is empty, its document is the end id alone; repeated rows are
packed once each; doc_id may be null; a very long text is one row's work and needs some
twenty times its size in memory; an empty table gives no rows; other columns are ignored.
sequence_id names a piece by its partition and place there: it is unique, and the same in
every run over the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, ship
from .words import mergeable, word_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"
#: Pieces handed on at once.
ROWS = 8192


def binary_lengths(n: int, longest: int = 2048) -> list[int]:
    """Powers of two, at most longest, that add up to n; the longest first."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of the pieces of rows with so many ids: binary_lengths of each, one after the other."""
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    row, bit = np.nonzero(counts[:, None] % longest & bits)
    full = counts // longest
    rows = np.concatenate((np.repeat(np.arange(len(counts)), full), row))
    lengths = np.concatenate((np.full(full.sum(), longest), bits[bit]))
    order = np.argsort(rows, kind="stable")
    return rows[order], lengths[order]


def decompose(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit; null unless with_ids),
    ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length)."""
    binary_lengths(0, longest)  # checks longest
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(mergeable(tokenizer) or {})  # the vocabulary, some 50,000 tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, ranks=shared.value)
        for batch in batches:
            for at, ids, bounds in encoder.encode_texts(batch.column(1), end_id):
                counts = np.diff(bounds)
                row, length = pieces_of(counts, longest)
                begin = np.cumsum(length) - length
                data = memoryview(ids.tobytes())
                for a in range(0, len(row), ROWS):
                    rows, lengths, begins = row[a : a + ROWS], length[a : a + ROWS], begin[a : a + ROWS]
                    parts = [data[4 * x : 4 * (x + n)] for x, n in zip(begins.tolist(), lengths.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows + at)),
                            pa.array(begins - bounds[rows]),
                            pa.array(lengths.astype(np.int64)),
                            pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                            pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                            pa.array(counts[rows]),
                        ],
                        ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"],
                    )
        release()

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def batches(pieces: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """pieces, written to files before, with the batch of its bucket each one is drawn into, from 0, and place in it.

    A batch holds max(1, tokens / length) sequences of one length; only the last of a bucket
    holds less. Pieces are numbered within the partition that made them, and partitions are
    put together by their counts, so no bucket is gathered in a task.
    """
    made = pieces.withColumn("__wm_part", F.shiftright("sequence_id", 33))
    counts = made.groupBy("bucket", "__wm_part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("bucket").orderBy("__wm_part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("bucket", "__wm_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__wm_first"))
    rank = F.row_number().over(W.partitionBy("bucket", "__wm_part").orderBy("sequence_id")) - 1
    numbered = made.withColumn("__wm_rank", rank).join(first, ["bucket", "__wm_part"]).withColumn("__wm_rank", F.col("__wm_first") + F.col("__wm_rank"))
    size = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length"))).cast("long")
    return numbered.select(*pieces.columns, F.floor(F.col("__wm_rank") / size).alias("batch"), F.pmod("__wm_rank", size).alias("place"))
