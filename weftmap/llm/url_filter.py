"""URL filters: a Bloom filter cascade with exact membership over the corpus's keys.

Level 1 encodes the listed keys. Level 2 encodes the unlisted keys of the corpus that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until
a level lets through nothing it shouldn't. Walking the levels then answers exactly for
every key of the corpus, with no join: a level is one literal array of words, probed by
native hashes. The size of the levels follows the lists (and the few false positives),
not the corpus. Lists whose first level would be beyond ``max_bytes`` (2.8 million keys
for 4 MB) aren't put into a plan: they meet the distinct keys of the urls in a join.

A key is a host suffix (on label borders) plus a leading part of the path, of one of the
label counts and lengths that occur in the list; so a rule is found by the keys of a url
alone, and a host of many labels has no more keys than another.

Defined cases: very long urls cost their length; null urls and urls without ``://`` have empty host and path, and no key;
an empty list matches nothing; repeated rows are judged alike; rules of equal length are
ordered by host length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BYTES, Level, build_level, in_level, level_bytes


@dataclass(frozen=True)
class Cascade:
    """Levels of a cascade; odd ones (from the first) encode listed keys."""

    levels: tuple[Level, ...]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.lit(2**31 - 1))
    ok = url.isNotNull() & (at > 0)
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(F.substring(rest, F.char_length(raw_host) + 1, F.lit(2**31 - 1)), r"^[^?#]*", 0)
    return F.when(ok, F.translate(raw_host, upper, lower)).otherwise(""), F.when(ok, path).otherwise("")


def url_keys(host: Column, path: Column, labels: list[int], path_lengths: list[int]) -> Column:
    """Keys of a url with host suffixes of so many labels and leading parts of the path of such lengths, the longest first."""
    n_labels = F.char_length(host) - F.char_length(F.replace(host, F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*[F.when((host != "") & (n_labels >= n), F.substring_index(host, ".", -n)) for n in labels]))
    fitting = F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.char_length(path))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct((-F.char_length(h) - n).alias("len"), (-F.char_length(h)).alias("host_len"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.sort_array(pairs), lambda p: p["key"])


def contains(key: Column, cascade: Cascade) -> Column:
    """Exact for every key of the universe the cascade was built over."""
    answer = F.lit(len(cascade.levels) % 2 == 1)
    for k in range(len(cascade.levels) - 1, -1, -1):
        # not in level k: listed if k is even-numbered from 1, else unlisted
        answer = F.when(in_level(key, cascade.levels[k]), answer).otherwise(F.lit(k % 2 == 1))
    return answer


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 12, hashes: int = 4, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Cascade for listed (column key) that is exact over listed and universe (column key);
    None if its first level, the largest, would be beyond max_bytes.

    The universe is streamed through level 1; only keys that pass are made distinct and
    compared with the list, so the shuffle holds the false positives and the list's hits.
    From the eighth level on keys get ever more bits, so the cascade ends however few it began with.
    """
    inside = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n = inside.count()
    if not n:
        return Cascade(())
    if level_bytes(n, bits_per_key) > max_bytes:
        return None
    levels = [build_level(inside, level_bytes(n, bits_per_key), 1, hashes)]
    outside = universe.select("key").where(in_level(F.col("key"), levels[0])).distinct().join(inside, "key", "left_anti").persist()
    try:
        wanted, other = outside, inside
        while n := wanted.count():
            if level_bytes(n, bits_per_key) > max_bytes:
                return None
            more = bits_per_key << max(0, len(levels) - 7)
            levels.append(build_level(wanted, level_bytes(n, more), len(levels) + 1, max(hashes, min(16, more // 2)) if more > bits_per_key else hashes))
            wanted, other = other.where(in_level(F.col("key"), levels[-1])), wanted
    finally:
        outside.unpersist()
    return Cascade(tuple(levels))


def as_keys(like: DataFrame, values: list[str] | tuple[str, ...]) -> DataFrame:
    """A column key with the values, made of one literal."""
    return like.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(list(values))), "array<string>")).alias("key"))


def first_listed(rows: DataFrame, keys: Column, listed: DataFrame, name: str, **sizes) -> DataFrame:
    """rows and one more column, the first of each row's keys that is listed (column key)."""
    cascade = build_cascade(listed, rows.select(F.explode(keys).alias("key")), **sizes)
    if cascade is not None:
        return rows.withColumn(name, F.get(F.filter(keys, lambda k: contains(k, cascade)), F.lit(0)))
    # a list too long to be part of a plan: distinct key arrays meet it by a join
    keyed = rows.withColumn("__wm_keys", keys)
    single = keyed.select("__wm_keys").distinct()
    hits = single.select("__wm_keys", F.posexplode("__wm_keys").alias("pos", "key")).join(listed.select("key").distinct(), "key", "left_semi")
    first = hits.groupBy("__wm_keys").agg(F.min_by("key", "pos").alias(name))
    return keyed.join(first, "__wm_keys", "left").drop("__wm_keys")


def judge_urls(
    pages: DataFrame,
    block: list[tuple[str, str]],
    allow: list[tuple[str, str]],
    block_labels: tuple[str, ...] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    **sizes,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_label): one row per row of pages.

    Rules are (host, path). The longest listed key of a url decides; without one, a host
    with a word (split at dots and hyphens) listed in block_labels is blocked, others are
    allowed. Three lists are matched: all rules, the blocking ones, and the words.
    """
    rules = sorted({h + p for h, p in [*block, *allow]})
    blocking = sorted({h + p for h, p in block} - {h + p for h, p in allow})
    lengths = sorted({len(p) for _, p in [*block, *allow]}, reverse=True) or [0]
    labels = sorted({h.count(".") + 1 for h, _ in [*block, *allow]}, reverse=True) or [1]
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = as_keys(pages, rules)
    found = first_listed(urls, url_keys(F.col("host"), F.col("path"), labels, lengths), listed, "rule", **sizes)
    # asked only about keys that are rules, so the rules are its universe
    blocked = build_cascade(as_keys(pages, blocking), listed, **sizes)
    if blocked is None:
        found = found.join(as_keys(pages, blocking).select(F.col("key").alias("rule"), F.lit(True).alias("__wm_bad")), "rule", "left")
        bad = F.coalesce("__wm_bad", F.lit(False))
    else:
        bad = contains(F.col("rule"), blocked)
    found = first_listed(found, F.split("host", r"[.\-]"), as_keys(pages, block_labels), "block_label", **sizes)
    verdict = F.when(F.col("rule").isNotNull(), bad).otherwise(F.col("block_label").isNotNull())
    return found.select("page_id", "host", "path", "rule", F.when(verdict, "block").otherwise("allow").alias("verdict"), "block_label")
