"""The near_dedup stage against brute-force similarity of five-word shingles."""

import itertools
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftmap.llm import similar
from weftmap.llm.shingles import shingle_sets


def plain_set(text, size=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain_roots(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root = [root[a] if x == root[b] else x for x in root]
    return root


def changed(r, words, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.random()}"
    return words


def test_shingle_sets_against_plain_ones(texts):
    """As many shingles in each set, and in what two sets share, as plain sets of words have."""
    r = random.Random(31)
    made = [*texts, "x" * 9000, "x" * 9000 + "y", "y" + "x" * 9000, "x" * 4096 + "ab", "x" * 4096 + "ba", "\x0b a\tb\x0c C  d e F g "]
    made += [" ".join(r.choice(("a", "b", "ab", "ba", "é", "A")) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for size in (1, 3, 5):
        plain = [plain_set(t, size) for t in made]
        got = [set(x.tolist()) for x in shingle_sets(pa.array(made, pa.string()), size)]
        assert list(map(len, got)) == list(map(len, plain)) and len(set().union(*got)) == len(set().union(*plain))
        for _ in range(3000):
            i, j = r.randrange(len(made)), r.randrange(len(made))
            assert len(got[i] & got[j]) == len(plain[i] & plain[j])
        assert [set(x.tolist()) for x in shingle_sets(pa.array(made, pa.string()).slice(7), size)] == got[7:]


@pytest.fixture(scope="module")
def mixture():
    """Copies around 0.8, a large group of copies, and documents with much in common below it."""
    r = random.Random(17)
    texts = []
    for n in (5, 12, 40, 150, 400, 1030, 2060):
        for _ in range(8):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(words)] + [" ".join(changed(r, words, max(1, n * share // 1000))) for share in (4, 12, 20, 22, 25, 30)]
    words = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts += [" ".join(changed(r, words, r.randint(1, 6))) for _ in range(80)]
    line = [f"l{k}" for k in range(60)]
    texts += [" ".join(line + [f"w{r.randrange(10**6)}" for _ in range(r.randint(3, 40))]) for _ in range(60)]
    r.shuffle(texts)
    return texts


def test_near_against_brute_force(spark, mixture):
    root = plain_roots(mixture)
    first = sorted({x: k for k, x in reversed(list(enumerate(root)))}.values())
    assert 100 < len(first) < len(mixture) - 100
    rows = spark.createDataFrame(list(enumerate(mixture)), "doc_id long, text string").repartition(5)
    assert sorted(r[0] for r in corpus_pipeline.near(spark, rows, "").collect()) == first


def test_near_without_common_shingles(spark, mixture, monkeypatch):
    monkeypatch.setattr(similar, "OFTEN", 1 << 30)
    test_near_against_brute_force(spark, mixture)


def test_near_with_all_shingles_common(spark, mixture, monkeypatch):
    """Everything is told, in stretches of a few documents."""
    for name, value in (("OFTEN", 1), ("STRETCH", 1000)):
        monkeypatch.setattr(similar, name, value)
    test_near_against_brute_force(spark, mixture)


def test_few_pairs_share_a_passage(spark, monkeypatch):
    """Documents that have a passage, a third of each, in common don't meet in pairs."""
    r = random.Random(29)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"w{r.randrange(10**6)}" for _ in range(120))]) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared = []
    plain = similar.similar
    monkeypatch.setattr(similar, "similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    assert corpus_pipeline.near(spark, rows, "").count() == 200
    assert sum(compared) < 400


def test_variants_of_a_short_text_meet_as_far_as_parities_allow(spark, monkeypatch):
    """Hundreds of variants, each below the similarity to all others, share their keys, but aren't paired."""
    r = random.Random(37)
    base = [f"b{k}" for k in range(30)]
    texts = [" ".join(changed(r, base, 2)) for _ in range(150)]
    assert len(set(plain_roots(texts))) > 140
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared = []
    plain = similar.similar
    monkeypatch.setattr(similar, "similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    assert corpus_pipeline.near(spark, rows, "").count() == len(set(plain_roots(texts)))
    assert compared[1] < 200


def test_one_common_line_is_no_near_copy(spark):
    """A line repeated 45 times decides every bit of a fingerprint that counts repeats."""
    r = random.Random(19)
    line = "all of these words are on each page again and again"
    texts = [" ".join([line] * 45 + [f"w{r.randrange(10**6)}" for _ in range(200)]) for _ in range(6)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near(spark, rows, "").count() == 6


def test_buckets_of_the_same_nodes_are_paired_once(spark):
    """Keys 1 to 3 have the same nodes; 4 one more, 5 two alone, 6 one component alone."""
    part = {10: 10, 11: 10, 12: 12, 13: 13}
    buckets = {1: (10, 11, 12), 2: (10, 11, 12), 3: (10, 11, 12), 4: (10, 11, 12, 13), 5: (12, 13), 6: (10, 11)}
    members = spark.createDataFrame([(k, node, part[node]) for k, nodes in buckets.items() for node in nodes], "key long, node long, part long")
    assert sorted(map(tuple, similar.divided(members).collect())) == [(1, 10, 3), (4, 10, 4)]


def test_short_parities_tell_large_sets_apart():
    """Sets of 900 shingles that share two thirds of them don't fit by short parities."""
    r = np.random.default_rng(43)
    shared, *own = (r.integers(0, 1 << 63, n, np.uint64) for n in (600, 300, 300))
    a, b = (np.bitwise_xor.reduce(similar.parities(np.concatenate((shared, x))).reshape(-1, similar.SHORT), axis=0) for x in own)
    assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) * 9 > 1800


def test_golay_keys_link_close_copies(spark, monkeypatch):
    """Close copies are linked by their fingerprints' keys; nothing is left for the set join to compare."""
    r = random.Random(41)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate([*texts, *(t + " more" for t in texts)])), "doc_id long, text string").repartition(4)
    compared = []
    monkeypatch.setattr(similar, "similar", lambda pairs, *more: compared.append(pairs.count()) or pairs.where("false"))
    assert sorted(r[0] for r in corpus_pipeline.near(spark, rows, "").collect()) == list(range(20))
    assert compared == [0, 0]


def test_fingerprint_links_are_confirmed_on_sets(spark, mixture, monkeypatch):
    """Whatever the keys propose, only sets of a similarity of 0.8 or more link."""
    every = lambda values: values.alias("x").join(values.alias("y"), F.col("x.node") < F.col("y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    monkeypatch.setattr(similar.simhash, "links", every)
    monkeypatch.setattr(similar, "similar", lambda pairs, *more: pairs.where("false"))
    texts = mixture[:60]
    first = sorted({x: k for k, x in reversed(list(enumerate(plain_roots(texts))))}.values())
    assert len(first) < len(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r[0] for r in corpus_pipeline.near(spark, rows, "").collect()) == first


def test_groups_are_known_by_more_than_an_id(spark):
    """Unrelated texts with null ids, and one id on two texts; copies of each still go."""
    r = random.Random(23)
    one, two, three, four = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(None, one), (None, two), (None, two + " more"), (7, three), (7, four), (8, four + " more"), (None, three + " more")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r[0] is None, r[0], r[1]) for r in got if r[0]) == sorted([(False, 7, three), (False, 7, four)])
    nulls = [t for k, t in got if k is None]
    assert len(nulls) == 2 and one in nulls and len(got) == 4


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_id_with_nothing_to_learn_from(spark, lang):
    """No labels, or labels in the held-out fold alone."""
    held = [(k, "some text here", lang) for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    rows = [*held, (None, "a b", None), (1, "123 !", None), (2, None, None), (4, "", None), (6, "\u00e9", None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted((str(x[0]), x[1]) for x in got) == sorted((str(k), t) for k, t, _ in [*held, (None, "a b", None), (6, "\u00e9", None)])
