import hashlib
import json
import random
import re
import weakref
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftmap.llm import bpe, langid, license_scan, packing, token_counts, words
from weftmap.llm.queries import vocabulary
from weftmap.llm.words import WordEncoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def by_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# 1


def plain_scan(text, phrases):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    starts, labels = [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        starts += found
        labels |= {label} if found else set()
    return words, starts, sorted(labels)


def plain_matches(words, templates, stride):
    out = set()
    for b in range(-(-len(words) // stride)):
        inside = set(words[b * stride : (b + 2) * stride])
        out |= {(t.name, b) for t in templates if len(inside & set(t.words)) >= t.need}
    return out


def test_license_scan(spark, docs, none):
    r = random.Random(2)
    vocabulary_words = "cc by all rights reserved general public license the mit released under apache version 2 0 nc x y z this work is licensed gnu 3".split()
    rows = [(k + 20_000, " ".join(r.choice(vocabulary_words) for _ in range(r.randint(0, 300))) + r.choice(["", " CC-BY 4.0", "\nAll Rights Reserved."])) for k in range(150)]
    rows += [(k + 30_000, t) for k, t in enumerate(["cc by", "CCKBY", "cc bye", "x " * 63 + "cc by", "x " * 31 + "all rights reserved", "General-Public/License cc by cc by"])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    both = extra.unionByName(docs.select("doc_id", "text"))
    found = license_scan.license_scan(both).collect()
    texts = {(x["doc_id"], x["text"]) for x in both.collect()}
    counts = license_scan.word_counts(both, sorted({w for n in [*license_scan.PHRASES, *license_scan.NOTICES] for w in n.split()}))
    templates = license_scan.order_templates(license_scan.PHRASES, counts, 0.8, True) + license_scan.order_templates(license_scan.NOTICES, counts, 0.8)
    by_id = {}
    for k, t in texts:
        by_id.setdefault(k, t)
    assert len(found) == both.count()
    hits = 0
    for x in found:
        words, starts, labels = plain_scan(by_id[x["doc_id"]], license_scan.PHRASES)
        assert x["n_words"] == len(words) and sorted(x["starts"]) == sorted(starts) and x["base_labels"] == labels
        # a last block may begin in the window of the one before: it then holds nothing new
        want = plain_matches(words, templates, 32)
        assert {(m["name"], m["block"]) for m in x["matches"]} == want
        assert set(labels) <= set(x["labels"]) and 0 <= x["score"] <= 1 and (x["score"] > 0) == bool(want)
        hits += bool(want)
    assert hits > 50
    assert license_scan.license_scan(none).count() == 0


# 2


def test_binary_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 5000]:
        found = packing.binary_lengths(n)
        assert sum(found) == n and all(x & (x - 1) == 0 and x <= 2048 for x in found) and found == sorted(found, reverse=True)
    with pytest.raises(ValueError):
        packing.binary_lengths(5, 100)


def test_packing(docs, none):
    t = Tokenizer.from_file(WORD)
    pieces = packing.decompose(docs, WORD).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and all(p["offset"] == 0 for p in pieces)
    got = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] and 1 << p["bucket"] == p["length"]
        got.setdefault(p["doc_id"], []).append((p["start"], p["doc_tokens"], ids))
    for row in docs.select("doc_id", "text").distinct().collect():
        want = t.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        copies = 3 if row["doc_id"] == 30 else 1
        found = got[row["doc_id"]]
        assert all(x[1] == len(want) for x in found) and sum(len(x[2]) for x in found) == copies * len(want)
        assert all(want[x[0] : x[0] + len(x[2])] == x[2] for x in found)
    assert packing.decompose(none, WORD).count() == 0


def test_batches(docs, tmp_path):
    path = str(tmp_path / "pieces")
    packing.decompose(docs.repartition(3), WORD).write.parquet(path)
    pieces = docs.sparkSession.read.parquet(path)
    found = packing.batches(pieces, 64).collect()
    assert len(found) == pieces.count() and len({(p["bucket"], p["batch"], p["place"]) for p in found}) == len(found)
    sizes = {}
    for p in found:
        assert p["place"] < max(1, 64 // p["length"])
        sizes.setdefault(p["bucket"], {}).setdefault(p["batch"], []).append(p["place"])
    for bucket, by_batch in sizes.items():
        assert sorted(by_batch) == list(range(len(by_batch)))
        assert all(len(by_batch[k]) == max(1, 64 >> bucket) for k in range(len(by_batch) - 1))
    assert packing.batches(pieces.limit(0)).count() == 0


@pytest.mark.parametrize("special", [False, True])
def test_word_encoder_against_library(texts, special):
    """Letters that end in a mark when composed or lowered, code points of many scripts, and each one alone."""
    encoder, t = WordEncoder(WORD, special), Tokenizer.from_file(WORD)
    t.encode_special_tokens = special
    r = random.Random(21)
    pools = ["".join(map(chr, range(0x1000))), "".join(map(chr, range(0x3000))), "İक़य़़,.'st '’re<|endoftext|>Σσςſ\u0327\u0301ﬁÅéÉ 1２\x1c\x85\u3000", "".join(map(chr, range(0x20, 0x180)))]
    made = [*texts, "İ,", "क़,", "य़.", "ढ़!", "a" * 300 + ".", "x\x01y"] + [chr(k) + s for k in range(0x2000) for s in ("", ",")]
    made += ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) + r.choice(["", "<|endoftext|>", " x", "'s", "."]) for pool in pools for _ in range(10_000)]
    want = [e.ids for e in t.encode_batch_fast([x or "" for x in made], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(made)] == want


def test_word_encoder_in_small_stretches(texts):
    t = Tokenizer.from_file(WORD)
    small = WordEncoder(WORD, stretch_bytes=50)
    for text, ids in zip(texts, small.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
    assert small.encode(None) == b"" and small.encode_all([]) == []


def test_a_worker_keeps_one_operators_tables():
    """A stage's tables aren't left in a worker for the stages after it."""
    counts = langid.Counts(("en",), np.zeros(1, np.int64), np.array([ord("a")], np.uint32), np.ones(1))
    model = weakref.ref(langid._model(counts))
    assert langid._model(counts) is model()
    encoder = weakref.ref(words.word_encoder(WORD))
    assert words.word_encoder(WORD) is encoder() and model() is None
    assert langid._model(counts) and encoder() is None


def test_every_token_is_mergeable_or_left_out():
    """What the byte-level encoder rests on: a token's own bytes merge into it, by one pair only."""
    with open(WORD, encoding="utf-8") as file:
        model = json.load(file)["model"]
    assert len({"".join(m) for m in model["merges"]}) == len(model["merges"])
    assert len(words.mergeable(WORD)) == len(model["vocab"])
    assert words.mergeable(BYTE) is None  # of another kind


def test_forget():
    assert set(bpe.forget({"a" * k: b"" for k in range(1, 11)})) == {"a" * k for k in range(1, 5)}


# 3


def plain_bits(counts, language, text):
    """The same code length, a byte at a time."""
    data = langid.to_bytes(text)
    tree = {}
    for lang, gram, n in zip(counts.language, counts.gram, counts.n):
        if lang == language:
            g = int(gram).to_bytes(4, "big")
            for k in range(4):
                node = tree.setdefault(g[3 - k : 3], {})
                node[g[3]] = node.get(g[3], 0) + n
    bits = 0.0
    for i in range(3, len(data)):
        ruled_out = set()
        for k in range(3, -1, -1):
            seen = {s: n for s, n in tree.get(data[i - k : i], {}).items() if s not in ruled_out}
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= np.log2(seen[data[i]] / total)
                break
            if seen:
                bits -= np.log2(len(seen) / total)
                ruled_out |= set(seen)
        else:
            bits += np.log2(256 - len(ruled_out))
    return bits


def test_code_lengths_are_exact(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(("the", "and", "of") if k % 2 else ("der", "und", "für")) for _ in range(40)), "en" if k % 2 else "de") for k in range(30)]
    counts = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.Model(counts)
    made = ["the end", "und für die", "xyz £", "a", "für" * 50, "", "漢字", "the und of der " * 9]
    for text in made:
        got = model.bits([text])[0]
        assert got == pytest.approx([plain_bits(counts, k, text) for k in range(2)], rel=1e-5)
    assert np.allclose(model.bits(made * 3), np.concatenate([model.bits([t]) for t in made] * 3))


def test_code_lengths_of_a_large_sample(spark):
    """Real texts of four languages, all contexts kept; long texts in stretches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = langid.learn(docs)
    model = langid.Model(counts)
    for text in ["Die the het, les où?", "x" * 40]:
        assert model.bits([text])[0] == pytest.approx([plain_bits(counts, k, text) for k in range(len(counts.languages))], rel=1e-5)
    long = "the quick und für " * 150_000
    assert model.bits([long])[0] == pytest.approx(model.bits(["the quick und für " * 2])[0] + 149_998 * (model.bits(["the quick und für " * 3])[0] - model.bits(["the quick und für " * 2])[0]), rel=1e-5)


def test_sample_is_bounded_by_bytes(spark):
    rows = [(k, f"word{k} " * 200, "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_ = langid.learn(docs, sample_bytes=20_000), langid.learn(docs)
    assert 0 < few.n.sum() < 100_000 < all_.n.sum()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 100 and sum(x["lang"] == x["lang_pred"] for x in found) / len(found) > 0.97
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in found)


def test_language_of_odd_rows(docs, none, texts):
    found = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    for k, text in enumerate(texts):
        letters = bool(text) and any(c.isalpha() for c in text)
        assert found[k]["lang_pred"] == ("en" if letters else "und") and 0 <= found[k]["score"] <= 1
    assert found[None]["lang_pred"] == "en" and found[None]["held_out"] is False
    assert langid.identify(none).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {x["lang_pred"] for x in langid.identify(unlabelled).collect()} == {"und"}


def test_prediction_ignores_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    predict = langid.predictor(docs)
    one = docs.select("doc_id", predict("text").alias("p"))
    two = docs.selectExpr("doc_id", "text", "'zz' as lang").select("doc_id", predict("text").alias("p"))
    assert by_rows(one, "doc_id", "p") == by_rows(two, "doc_id", "p")


# 4


def test_token_counts(docs, none, texts):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    want = sorted([(k, len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts)] + [(30, len(t.encode(texts[30], add_special_tokens=False).ids))] * 2 + [(None, 3)], key=str)
    for size in (7, 1 << 16):
        assert by_rows(token_counts.count_tokens(docs, WORD, 49407, size), "doc_id", "n_tokens") == want
    assert token_counts.count_tokens(none, WORD, 49407).count() == 0


def test_separators_across_blocks(spark):
    r = random.Random(8)
    rows, want = [], []
    for file in range(4):
        ids = [r.choice((0, 1, 2, 9)) for _ in range(r.randint(0, 60))]
        at = k = 0
        while at < len(ids) or k == 0:
            step = r.randint(0, 9)
            rows.append((file, k, np.array(ids[at : at + step], "<u4").tobytes()))
            at += step
            k += 1
        start = 0
        for i, x in enumerate(ids):
            if x == 9:
                want.append((file, start, i - start, True))
                start = i + 1
        if start < len(ids):
            want.append((file, start, len(ids) - start, False))
    found = token_counts.scan_separators(spark.createDataFrame(rows, "file long, block long, ids binary"), 9)
    got = sorted((x["file"], x["ordinal"], x["start"], x["n_tokens"], x["closed"]) for x in found.collect())
    assert [(f, s, n, c) for f, _, s, n, c in got] == want
    assert all(o == sum(1 for y in got if y[0] == f and y[2] < s) for f, o, s, _, _ in got)


@pytest.mark.parametrize("width", [2, 4])
def test_flat_files(spark, tmp_path, width):
    """Files written elsewhere, read in byte ranges; one of them empty, one not closed."""
    r = random.Random(31)
    want = {}
    for name, n in (("a b.bin", 1000), ("c.bin", 0), ("d%20.bin", 37), ("e.bin", 16)):
        ids = [r.choice((1, 2, 3, 9)) for _ in range(n)]
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
        start = 0
        for i, x in enumerate([*ids, 9]):
            if x == 9 and not (i == len(ids) and start == i):
                want.setdefault(name, []).append((start, i - start, i < len(ids)))
                start = i + 1
    blocks = token_counts.read_flat(spark, str(tmp_path), block_ids=16, id_bytes=width)
    got = {}
    for x in token_counts.scan_separators(blocks, 9).orderBy("file", "ordinal").collect():
        got.setdefault(x["file"], []).append((x["start"], x["n_tokens"], x["closed"]))
    assert sorted(got.values()) == sorted(want.values())
    (tmp_path / "odd.bin").write_bytes(b"\0" * (width + 1))
    with pytest.raises(Exception, match="in ids of"):
        token_counts.read_flat(spark, str(tmp_path), 16, width).count()


# 9


def test_bpe(docs, none, texts):
    t = Tokenizer.from_file(BYTE)
    found = bpe.encode_docs(docs, BYTE).collect()
    digests = {x["doc_id"]: x for x in bpe.encode_digests(docs, BYTE).collect()}
    assert len(found) == docs.count()
    for x in found:
        text = "no id here" if x["doc_id"] is None else texts[x["doc_id"]]
        want = t.encode(text or "", add_special_tokens=False).ids
        assert x["ids"] == want and x["decoded"] == t.decode(want, skip_special_tokens=False)
        d = digests[x["doc_id"]]
        assert d["n_tokens"] == len(want) and d["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(x["decoded"].encode()).hexdigest()
    assert bpe.encode_docs(none, BYTE).count() == 0


def test_neighbours_against_merging():
    """Whether two tokens may stand side by side, by their borders and by merging their joined bytes."""
    b, r = bpe.TrieBpe(BYTE), random.Random(3)
    ids = sorted(b.ids.values())
    short = [i for i in ids if len(b.pieces[i]) <= 3]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(4000)] + [(r.choice(short), r.choice(short)) for _ in range(4000)]
    pairs += [(b.ids[x], b.ids[y]) for x, y in r.sample(sorted(b.ranks), 4000)]
    for c in (b" ", b"a", b"-", b"\n", b"0"):
        runs = [b.ids[c * k] for k in range(1, 70) if c * k in b.ids]
        pairs += [(x, y) for x in runs for y in runs]
    for x, y in pairs:
        assert b.compatible(x, y) == (b.merge(b.pieces[x] + b.pieces[y]) == [b.pieces[x], b.pieces[y]])


def test_bpe_small_cache_and_cut_characters():
    t, b = Tokenizer.from_file(BYTE), bpe.TrieBpe(BYTE, cache_units=20)
    r = random.Random(6)
    letters = "aeinrst ABC,.;'019\n\té漢🙂-=_ "
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
        if r.random() < 0.5:
            b.warm([text])
        ids = t.encode(text, add_special_tokens=False).ids
        assert b.encode(text) == ids and b.decode(ids).decode() == text
        if len(ids) > 1:
            assert b.decode(ids[1:]).decode() == t.decode(ids[1:], skip_special_tokens=False)
