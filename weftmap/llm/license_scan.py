"""License scans: exact set-similarity join of text blocks with licence templates.

Texts are cut into words and the words into overlapping blocks (64 words, one every 32).
A block matches a template when it holds at least ``threshold`` of the template's
distinct words. The join is exact: words are ordered by their count in the whole corpus,
rarest first; a block can only match a template if it holds one of the template's first
``|T| - need + 1`` words (prefix filter), has enough template words (length filter), and
enough of them are left after the first shared one in both orders (positional filter).
The templates are a fixed, small list, so the inverted index of their prefixes is part of
the plan, and the join needs no shuffle: whatever a document holds, its blocks are joined
where the document is read. One earlier pass counts the template words in the corpus.

Phrases are templates all of whose words are needed; their places in the matching blocks
are then found by comparing words in order.

Defined cases: null text is empty; a text without words has no label, null positions and
score 0; repeated rows give repeated rows; an empty table gives no rows; columns other
than the two named are ignored. Only A-Z are lower-cased.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known licence notices, as words, and labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    words: tuple[str, ...]  # distinct, the globally rarest first
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Places of each vocabulary word in the whole corpus; the result is as small as the vocabulary."""
    found = docs.select(F.explode(F.filter(word_array(F.col(text_col)), lambda w: w.isin(*vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def order_templates(named: dict[str, str], counts: dict[str, int], threshold: float, whole: bool = False) -> list[Template]:
    out = []
    for name, label in named.items():
        words = sorted(set(name.split()), key=lambda w: (counts.get(w, 0), w))
        need = len(words) if whole else max(1, math.ceil(threshold * len(words) - 1e-9))
        out.append(Template(name, label, tuple(words), need))
    return out


def scan_blocks(docs: DataFrame, templates: list[Template], counts: dict[str, int], stride: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, matches array<struct<name, label, block, containment>>) a row of docs.

    Block b holds words b*stride to (b+2)*stride-1. Every block and template that meet
    the template's ``need`` are in matches.
    """
    longest = max(len(t.name.split()) for t in templates)
    if longest > stride:
        raise ValueError(f"stride {stride} is below the longest template's {longest} words")
    vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(vocabulary)}
    known = F.array(*[F.lit(w) for w in vocabulary])
    seeds = sorted({w for t in templates for w in t.prefix})

    def candidate_blocks(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*seeds), F.floor(i / stride).cast("int"))), lambda b: b.isNotNull())
        return F.array_distinct(F.flatten(F.transform(at, lambda b: F.when(b > 0, F.array(b - 1, b)).otherwise(F.array(b)))))

    def joined(ranks: Column, block: Column) -> Column:
        def one(t: Template) -> Column:
            own = [rank[w] for w in t.words]

            def bound(p: int) -> Column:
                q = F.array_position(ranks, F.lit(own[p]))
                return F.when(q > 0, F.least(F.lit(len(own) - p), (F.size(ranks) - q + 1).cast("int")))

            most = F.coalesce(*[bound(p) for p in range(len(t.prefix))], F.lit(0))
            overlap = F.when((F.size(ranks) >= t.need) & (most >= t.need), F.size(F.array_intersect(ranks, F.array(*[F.lit(r) for r in own])))).otherwise(0)
            return F.struct(
                F.lit(t.name).alias("name"), F.lit(t.label).alias("label"), block.alias("block"),
                F.when(overlap >= t.need, overlap / F.lit(float(len(own)))).alias("containment"),
            )

        return F.filter(F.array(*[one(t) for t in templates]), lambda m: m["containment"].isNotNull())

    def matches(words: Column) -> Column:
        def of_block(block: Column) -> Column:
            inside = F.slice(words, block * stride + 1, F.lit(2 * stride))
            ranks = F.filter(F.transform(inside, lambda w: F.array_position(known, w).cast("int")), lambda r: r > 0)
            return let(F.array_sort(F.array_distinct(ranks)), lambda rs: joined(rs, block))

        return F.flatten(F.transform(candidate_blocks(words), of_block))

    words = docs.select(F.col(id_col).alias("doc_id"), word_array(F.col(text_col)).alias("words"))
    empty = F.array().cast("array<struct<name:string,label:string,block:int,containment:double>>")
    return words.withColumn("matches", F.when(F.arrays_overlap("words", F.array(*[F.lit(w) for w in seeds])), matches(F.col("words"))).otherwise(empty))


def phrase_starts(words: Column, matches: Column, phrase: str, stride: int) -> Column:
    """Where the phrase stands word by word: array<int>, looked for in the blocks that match its template."""
    wanted = phrase.split()

    def in_block(block: Column) -> Column:
        last = F.least((block + 2) * stride, F.size(words)) - 1
        same = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(wanted)])
        return F.filter(F.sequence(block * stride, last), same)

    blocks = F.transform(F.filter(matches, lambda m: m["name"] == phrase), lambda m: m["block"])
    return F.array_distinct(F.flatten(F.transform(blocks, in_block)))


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, threshold: float = 0.8, stride: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, matches, starts (of all phrases), base_labels, labels (arrays), score.

    score is the largest containment that meets its threshold, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    vocabulary = sorted({w for name in [*phrases, *notices] for w in name.split()})
    counts = word_counts(docs, vocabulary, text_col)
    templates = order_templates(phrases, counts, threshold, whole=True) + order_templates(notices, counts, threshold)
    found = scan_blocks(docs, templates, counts, stride, id_col, text_col)
    starts = [phrase_starts(F.col("words"), F.col("matches"), p, stride) for p in phrases]
    none = F.array().cast("array<array<int>>")
    hit = F.size("matches") > 0
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), "matches", F.when(hit, F.array(*starts)).otherwise(none).alias("by_phrase"))
    base = [F.when(F.size(F.get("by_phrase", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    found = found.withColumn("base_labels", F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))))
    own = F.transform(F.filter("matches", lambda m: ~m["name"].isin(*phrases)), lambda m: m["label"])
    return found.select(
        "doc_id", "n_words", "matches", F.flatten("by_phrase").alias("starts"), "base_labels",
        F.array_sort(F.array_union("base_labels", own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )
