"""Near-duplicates by SimHash and Golay-code keys, confirmed on shingle sets, and an exact join for the rest.

Two texts link if the Jaccard similarity of their sets of shingles (as 64-bit hashes, see
``shingles``) is 4/5 or more.

First the method of ``simhash``: fingerprints of the sets, in several tables, fuzzy keys of
Golay codewords, buckets, pairs within 2 bits. Each of these pairs is confirmed on the two
sets, so no fingerprint alone links texts; what links are left make components.

Fingerprints of sets of that similarity may differ in more bits than a key allows, so the
links not found that way are found by a prefix-filtered set join: in any order of
all shingles, two sets of that similarity share one of their first ``n // 5 + 1`` shingles,
n being the set's size. These are a set's keys; sets that share one are a bucket. Pairs
that the fingerprints' links already connect aren't compared again.

The order puts shingles met often last, so that a much used line or passage isn't a key
unless a set has little else. Counts are taken in stretches of documents and only of what is
met repeatedly in one; which shingles are told changes the work, not the result.

Each member of a bucket is first compared with one member, another for each key; what is
then one component needs no more pairs. In buckets that still hold several components,
members outside the largest meet all members of other components, as far as sizes and
short parities allow. No bucket is cut.

Comparing: sizes, then parities, a bit for each shingle (bits in which two sets differ are
no more than the shingles in which they do), first 1,024, then as many as the sets are large,
then the sets themselves. Equal sets are one
node, so rows of equal sets share a component; null and blank texts have the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, hot_bound, join_sized, materialise, pick_rows, release, ship
from .shingles import shingle_sets
from .simhash import components

#: Shingles that are counted at once, the count in them from which one is told as common, and how many are told.
STRETCH, OFTEN, MAX_COMMON = 2 << 20, 3, 500_000
#: Parities of a set, at least; twice as many fold into these.
LEAST_BITS = 1024
#: Longs of short parities.
SHORT = 16
#: Fingerprints of a set.
TABLES = 4


def common_shingles(docs: DataFrame, size: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, by their lower 32 bits, in ascending order, and how often each was met; bounded by MAX_COMMON."""
    ship(docs.sparkSession)

    def told(sets: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(sets)
        sets.clear()
        found.sort()
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(found)))
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(found[first[often]].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for found in shingle_sets(batch.column(0), size):
                sets.append(found.astype(np.uint32))
                held += len(found)
                if held >= STRETCH:
                    yield told(sets)
                    held = 0
        if sets:
            yield told(sets)
        release()

    counted = docs.select(text_col).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).toArrow()
    shingles, n = top["shingle"].to_numpy().astype(np.uint32), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix(hashes: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of a set's n shingles, which ascend, those met often last; none of an empty set.

    common: the lower 32 bits of those told, ascending; what shares them with one counts as told.
    """
    if not len(hashes):
        return hashes
    most = len(hashes) // 5 + 1
    if len(common):
        low = hashes.astype(np.uint32)
        at = np.minimum(np.searchsorted(common, low), len(common) - 1)
        told = np.flatnonzero(common[at] == low)
        if len(told):
            rest = np.delete(hashes, told)
            if len(rest) >= most:
                return rest[:most]
            by_count = told[np.argsort(often[at[told]], kind="stable")]
            hashes = np.concatenate((rest, hashes[by_count]))
    return hashes[:most]


def parities(hashes: np.ndarray) -> np.ndarray:
    """As longs, whether an odd number of hashes has each remainder by a power of two not below their number."""
    width = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else LEAST_BITS
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def with_keys(docs: DataFrame, size: int, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns named in keep and s, a struct: node (of the set), n, keys, bits, short (parities by 1,024), fps (a fingerprint for each table)."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size, text_col))

    @F.arrow_udf("node long, n long, keys array<long>, bits array<long>, short array<long>, fps array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        common, often = shared.value
        for batch in batches:
            node, n = np.empty(len(batch), np.uint64), np.empty(len(batch), np.int64)
            fps = np.empty((len(batch), TABLES), np.uint64)
            keys, bits, short = [], [], []
            for row, hashes in enumerate(shingle_sets(batch, size)):
                node[row], n[row] = xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)
                keys.append(prefix(hashes, common, often).view(np.int64))
                bits.append(parities(hashes))
                short.append(np.bitwise_xor.reduce(bits[-1].reshape(-1, SHORT), axis=0))
                fps[row] = [simhash.majority(simhash.remix(hashes, k)) for k in range(TABLES)]
            columns = [pa.array(node.view(np.int64)), pa.array(n), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, bits, short, list(fps.view(np.int64))))]
            yield pa.StructArray.from_arrays(columns, ["node", "n", "keys", "bits", "short", "fps"])
        release()

    return docs.select(*keep, of(F.col(text_col)).alias("s"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n, centre) of keys that more than one node has; centre is one of the key's nodes."""
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    mixed = F.col("node").bitwiseXOR(F.col("key"))  # another order of nodes for each key
    shared = keys.groupBy("key").agg(F.min(mixed).alias("lo"), F.max(mixed).alias("hi")).where("lo < hi")
    return keys.join(shared.select("key", F.col("lo").bitwiseXOR(F.col("key")).alias("centre")), "key")


def compatible(a, b):
    """Whether sets of sizes a and b can have a similarity of 4/5."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def folded(bits: str, few):
    """The parities by a power of two of few longs; sets of compatible sizes are at most one power apart."""
    halves = F.zip_with(F.slice(bits, 1, few), F.slice(bits, few + 1, few), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(bits) > few, halves).otherwise(F.col(bits))


def sized(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sizes allow a similarity of 4/5, with n_a and n_b."""
    x, y = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").where(compatible(F.col("n_a"), F.col("n_b")))


def alike(likely: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(a, b) of those of likely (a, b, n_a, n_b) whose sets have a similarity of 4/5 or more; written."""
    likely = materialise(likely, "near-likely")
    wanted = materialise(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "place.*"), "near-wanted")

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashes.view(np.int64) for hashes in shingle_sets(batch, size)], pa.list_(pa.int64()))

    sets = materialise(pick_rows(docs, wanted).select("node", of(F.col(text_col)).alias("set")), "near-sets")
    x, y = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    found = likely.join(x, "a").join(y, "b").where(shared * 9 >= (F.col("n_a") + F.col("n_b")) * 4).select("a", "b")
    found = materialise(found, "near-links")
    discard(likely, wanted, sets)
    return found


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """Those of pairs (a, b) of nodes whose sets have a similarity of 4/5 or more; written.

    nodes: node, n, bits and the place of one row that has the set.
    """
    x, y = (nodes.select(F.col("node").alias(k), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    few = F.least(F.size("bits_a"), F.size("bits_b"))
    differing = F.zip_with(folded("bits_a", few), folded("bits_b", few), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    near = F.aggregate(differing, F.lit(0), lambda s, v: s + v) * 9 <= F.col("n_a") + F.col("n_b")
    return alike(sized(pairs, nodes).join(x, "a").join(y, "b").where(near).select("a", "b", "n_a", "n_b"), nodes, docs, size, text_col)


def fingerprint_links(nodes: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(a, b): pairs of nodes with fingerprints within 2 bits in a table, found by Golay-code keys and confirmed on the sets; written.

    nodes: node, n, fps and the place of one row that has the set. Equal fingerprints are made
    one before keys; its nodes are paired with the smallest of them.
    """
    values = nodes.select("node", F.posexplode("fps").alias("tab", "value")).select("node", F.struct("tab", "value").alias("fp"))
    firsts = materialise(values.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("many")), "near-fps")
    several = firsts.where("many > 1")
    same = join_sized(values, several, "fp", hot_bound(TABLES * nodes.count()), "many").where("node <> first").select(*ordered(F.col("node"), F.col("first")))
    near = simhash.links(firsts.select(F.col("first").alias("node"), "fp.tab", "fp.value"))
    pairs = same.union(near.select(*ordered(F.col("a"), F.col("b")))).distinct()
    found = alike(sized(pairs, nodes), nodes, docs, size, text_col)
    discard(firsts)
    return found


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that aren't in one component of roots (node, root)."""
    x, y = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def divided(members: DataFrame) -> DataFrame:
    """(key, main, all) of the buckets, of members (key, node, part), that hold several components and more than two nodes.

    main is the largest component, all the number of nodes. Of buckets of the same nodes, as a
    passage gives for each of its shingles, one stands for all: they give the same pairs.
    """
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same_{k}") for k in range(2)]
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"), *same)
    whole = parts.groupBy("key").agg(F.max(F.struct("size", "part")).alias("m"), F.sum("size").alias("all"), *(F.bit_xor(f"same_{k}").alias(f"same_{k}") for k in range(2)))
    # the two of a bucket of two have been compared
    whole = whole.where("all > 2 and m.size < all").select("key", F.col("m.part").alias("main"), "all", "same_0", "same_1")
    return whole.groupBy("main", "all", "same_0", "same_1").agg(F.min("key").alias("key")).select("key", "main", "all")


def links(nodes: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(a, b): pairs of nodes of a similarity of 4/5 or more that connect the same nodes as all such pairs.

    nodes: node, n, keys, bits, short, fps and the place of one row that has the set.
    """
    found = fingerprint_links(nodes, docs, size, text_col)
    shared = materialise(buckets(nodes), "near-buckets")
    stars = shared.where("node <> centre").select(*ordered(F.col("node"), F.col("centre"))).distinct()
    stars = materialise(apart(stars, components(found)), "near-stars")
    found = found.union(similar(stars, nodes, docs, size, text_col))
    members = shared.join(components(found), "node", "left").select("key", "node", "n", "centre", F.coalesce("root", "node").alias("part"))
    members = materialise(members, "near-members")
    discard(shared)
    main = materialise(divided(members), "near-main")
    split = join_sized(members, main, "key", hot_bound(main.count()), "all").join(nodes.select("node", "short"), "node")
    split = materialise(split.select("key", "node", "n", "part", "main", "short"), "near-split")
    x, y = split.where("part <> main").alias("x"), split.alias("y")
    left = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    differing = sum(F.bit_count(F.get("x.short", F.lit(k)).bitwiseXOR(F.get("y.short", F.lit(k)))) for k in range(SHORT))
    rest = x.join(y, left & compatible(F.col("x.n"), F.col("y.n")) & (differing * 9 <= F.col("x.n") + F.col("y.n"))).select(*ordered(F.col("x.node"), F.col("y.node"))).distinct()
    more = similar(rest.join(stars, ["a", "b"], "left_anti"), nodes, docs, size, text_col)
    return found.union(more)


def near_groups(docs: DataFrame, size: int = 5, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs, which has locators: the columns named in keep, the locator, and root, its component's smallest node."""
    rows = materialise(with_keys(docs, size, text_col, (*keep, "__wm_file", "__wm_row")), "near-rows")
    place = F.min(F.struct("__wm_file", "__wm_row")).alias("place")
    nodes = materialise(rows.groupBy("s.node").agg(F.first("s.n").alias("n"), F.first("s.keys").alias("keys"), F.first("s.bits").alias("bits"), F.first("s.short").alias("short"), F.first("s.fps").alias("fps"), place), "near-nodes")
    sizes = rows.groupBy("s.node").agg(F.count(F.lit(1)).alias("copies"))
    roots = components(links(nodes, docs, size, text_col))
    named = materialise(sizes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "copies"), "near-components")
    placed = rows.select(*keep, "__wm_file", "__wm_row", "s.node")
    return join_sized(placed, named, "node", hot_bound(rows.count()), "copies").select(*keep, "__wm_file", "__wm_row", "root")
