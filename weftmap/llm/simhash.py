"""SimHash near-duplicates: Golay-code fuzzy hashing, then components of the links.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of
a text's shingles. Two fingerprints link at ``2`` or fewer differing bits.

Keys: the 64 bits are segments of 23, 23 and 18 bits. In the binary Golay code every
23-bit word is within 3 bits of a codeword, so two words at most 2 bits apart share a
codeword within 4 bits of both (take the one next to a word half way); a word has 1 or 6
such codewords. By the pigeonhole principle one segment has no error, so equal segment
plus one fuzzy key of another segment is shared by every linked pair. Fingerprints are
made distinct before keys, pairs that share a key are compared bit by bit.

Buckets of more than ``pair_limit`` distinct fingerprints aren't paired: their members
are linked through words one bit away instead (two fingerprints are within 2 bits exactly
if some word is within one bit of both), which finds the same links' components with 65
rows a fingerprint. No bucket is cut.

One fingerprint finds copies that differ in little. With several tables, each of them the
same hashes mixed anew, a pair has as many chances; the links of all tables count.

Components: large-star and small-star steps on links between distinct fingerprints, each
step written to the shared checkpoint folder.

Defined cases: null or blank text has fingerprint zero and links like any other; a text
of fewer words than a shingle is one shingle; a very long text is hashed whole in one task,
with 8 bytes a word and a few times its size in memory; repeated rows share a component; a null
doc_id is never the smallest unless all are null; an empty table gives no rows; columns
other than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, discard, hot_bound, join_sized, materialise, ship

GAPS = re.compile(rb"[\x20\x09-\x0D]+")
MAX_BITS = 2


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of size words, joined by single spaces; of all words if fewer; none if blank."""
    import xxhash

    data = GAPS.sub(b" ", lower_ascii(text or "")).strip(b" ")
    if not data:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1)).tolist()
    ends = np.append(gaps, len(data)).tolist()
    if len(starts) <= size:
        return np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8").translate(_LOWER)


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """The fingerprint of shingle hashes: bits set in over half of them."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        bits = np.unpackbits(hashes[at : at + chunk].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def remix(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes for one more table: table 0 has them as they are, others mixed by an odd number of their own."""
    if not table:
        return hashes
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * table + 1)) % 2**64)
    mixed = (hashes ^ hashes >> np.uint64(33)) * odd
    return mixed ^ mixed >> np.uint64(29)


def fingerprints(docs: DataFrame, size: int = 3, text_col: str = "text", name: str = "fps", tables: int = 1) -> DataFrame:
    """docs with one more column, an array with a fingerprint, as a signed long, for each table."""
    ship(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.empty((len(batch), tables), np.uint64)
            for row, text in enumerate(batch):
                hashes = shingle_hashes(text.as_py(), size)
                values[row] = [majority(remix(hashes, k)) for k in range(tables)]
            yield pa.array(list(values.view(np.int64)), pa.list_(pa.int64()))

    return docs.withColumn(name, of(F.col(text_col)))


GENERATOR = 0b101011100011  # of the perfect binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@lru_cache(1)
def golay() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Tables: remainders of the three bytes of a word; for each remainder the patterns
    (word xor codeword) of all codewords within 4 bits, padded with -1 in an array."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    parts = np.array([[remainder(v << shift & (1 << 23) - 1) for v in range(256)] for shift in (0, 8, 16)], np.int64)
    singles = [1 << i for i in range(23)]
    near: list[list[int]] = [[] for _ in range(2048)]
    patterns = [0]
    seen = {0}
    for _ in range(4):
        patterns = [p for x in patterns for s in singles if not x & s and (p := x | s) not in seen and not seen.add(p)]
        for p in patterns:
            near[remainder(p)].append(p)
    near[0].append(0)
    table = np.full((2048, max(map(len, near))), -1, np.int64)
    for r, found in enumerate(near):
        table[r, : len(found)] = sorted(found)
    return parts, near, table


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into words, codeword) for every codeword within 4 bits of each 23-bit word."""
    parts, _, table = golay()
    rest = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16 & 127]
    patterns = table[rest]
    row, column = np.nonzero(patterns >= 0)
    return row, words[row] ^ patterns[row, column]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, key): any two fingerprints within 2 bits share a key."""
    x = fps.view(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    rows, keys = [], []
    for kind, (exact, fuzzy) in enumerate(((a, b), (b, a), (c, a))):
        row, code = codewords(fuzzy)
        rows.append(row)
        # codewords are 23 bits: kind 2 bits, equal segment 23 bits, codeword 23 bits
        keys.append(kind << 46 | exact[row] << 23 | code)
    return np.concatenate(rows), np.concatenate(keys)


def key_table(values: DataFrame) -> DataFrame:
    """(node, value, key) of the fuzzy keys of (node, tab, value); keys of different tables differ."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                node, tab, value = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 1 << 13).columns)
                row, key = fuzzy_keys(value)
                yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(value[row]), pa.array(tab[row].astype(np.int64) << 48 | key)], ["node", "value", "key"])

    return values.select("node", "tab", "value").mapInArrow(of, "node long, value long, key long")


def midpoints(values: DataFrame) -> DataFrame:
    """values and mid: each one, and the 64 words one bit away."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return values.select("node", "tab", F.explode(F.concat(F.array("value"), flips)).alias("mid"))


def links(values: DataFrame, pair_limit: int = 64) -> DataFrame:
    """(a, b) with a < b: links of nodes, from (node, tab, value), that connect the same nodes as
    all pairs of values of one table within 2 bits.

    Keys are made twice, once to count buckets and once to fill those of more than one
    member: most have one, and making keys costs less than storing them.
    """
    keys = key_table(values)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, "key"), "simhash-buckets")
    small = shared.where(F.col("n") <= pair_limit).select("key", "node", "value")
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")))
    near = F.bit_count(F.col("x.value").bitwiseXOR(F.col("y.value"))) <= MAX_BITS
    by_pairs = pairs.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = shared.where(F.col("n") > pair_limit).select("node", F.shiftright("key", 48).cast("int").alias("tab"), "value").distinct()
    mids = midpoints(crowded)
    centre = mids.groupBy("tab", "mid").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("tab", "mid", "a")
    by_mids = mids.join(centre, ["tab", "mid"]).where("node > a").select("a", F.col("node").alias("b"))
    return by_pairs.union(by_mids).distinct()


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes of edges (a, b).

    Each round's links are written; their number falls or their ends get smaller, so rounds
    end by themselves. A node of many links isn't dealt by its key alone.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        bound = hot_bound(2 * current.count(), hot_rows)
        # large star: a node's larger neighbours go to its smallest
        both = current.select("u", "v").union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large = join_sized(both.where("v > u"), least, "u", bound).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_sized(large, low, "u", bound).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, current = current, materialise(small.where("u <> v").distinct(), "links")
        discard(before, large)
        # stars only: no node is both a leaf and a root, and each leaf has one root
        roots = current.select(F.col("v").alias("u")).distinct()
        twice = current.groupBy("u").count().where("count > 1").select("u")
        if current.join(roots, "u", "left_semi").select("u").union(twice).isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), pair_limit: int = 64, tables: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fp long, component_id, and the columns named in keep.

    With more than one table, documents link if their fingerprints are within 2 bits in
    any of them; fp is that of the first, so documents that share it are one node.
    """
    hashed = fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__wm_text"), *keep), size, "__wm_text", "fps", tables).drop("__wm_text")
    rows = materialise(hashed.withColumn("fp", F.get("fps", F.lit(0))), "simhash")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    if tables == 1:
        values = nodes.select(F.col("fp").alias("node"), F.lit(0).alias("tab"), F.col("fp").alias("value"))
    else:
        values = materialise(rows.select("fp", "fps").distinct().select(F.col("fp").alias("node"), F.posexplode("fps").alias("tab", "value")).distinct(), "simhash-values")
    found = materialise(components(links(values, pair_limit)), "simhash-components")
    linked = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    bound = hot_bound(rows.count(), hot_rows)
    named = join_sized(linked, smallest, "root", bound, "nodes").select("fp", "component_id", "n")
    return join_sized(rows, materialise(named, "simhash-named"), "fp", bound).select("doc_id", "fp", "component_id", *keep)
