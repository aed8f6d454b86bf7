import hashlib
import itertools
import random
import re
import time
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from weftmap.llm import chat, exact_dedup, media, simhash, url_filter
from weftmap.llm.common import drop_rows, file_backed, with_locator

# 5


def plain_groups(rows):
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id, k))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        out += [(m[2], best[2], len(members), norm) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_groups(spark, docs, digest):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = exact_dedup.exact_groups(docs, digest).collect()
    assert sorted([(x["doc_id"], x["keep_id"], x["group_size"]) for x in found], key=str) == sorted([r[:3] for r in plain_groups(rows)], key=str)
    assert sum(x["kept"] for x in found) == len({r[3] for r in plain_groups(rows)})
    assert all(x["doc_id"] == x["keep_id"] for x in found if x["kept"])


@pytest.mark.parametrize(("hot_rows", "filter_bytes", "cut"), [(2, 8, 64), (3, 1 << 20, 1), (1024, 8, 1), (1024, 1 << 20, 64), (2, 1 << 20, 1)])
def test_exact_groups_either_side_of_the_bounds(spark, hot_rows, filter_bytes, cut):
    """Hot digests salted or not, a filter that lets nearly all through or nearly nothing, with and without collisions."""
    r = random.Random(3)
    rows = [(k if k % 7 else None, r.choice(["a b", "ab", " ab", "c", f"x{k}", f"y {k % 9}", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = exact_dedup.exact_groups(df, lambda t: F.substring(F.sha2(t, 256), 1, cut), hot_rows=hot_rows, filter_bytes=filter_bytes).collect()
    want = plain_groups([tuple(x) for x in rows])
    # of equal rows without an id any one may be named, which is null
    assert sorted([(x["doc_id"], x["keep_id"], x["group_size"]) for x in found], key=str) == sorted([x[:3] for x in want], key=str)
    assert sum(x["kept"] for x in found) == len({x[3] for x in want})


def test_digests_and_empty(docs, none):
    found = {x["doc_id"]: x["digest"] for x in exact_dedup.exact_groups(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert found[r["doc_id"]] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()
    assert exact_dedup.exact_groups(none).count() == 0


def test_stream_goes_on(spark, tmp_path):
    """State outlives a query: later files join groups of earlier ones."""
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k, texts in enumerate((["a b", "c", "ab"], ["c ", "d", " a b "], ["ab"])):
        rows = with_locator(spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
        made = exact_dedup.records(rows, exact_dedup.sha256, "doc_id", "text")
        made.write.mode("append").parquet(path)
        exact_dedup.stream_states(spark, exact_dedup.read_stream(spark, path, made.schema, 1), checkpoint, out)
    got = sorted((x["n"], x["best"]["doc_id"]) for x in exact_dedup.latest_states(spark, out).collect())
    assert got == [(1, 11), (2, 10), (4, 12)]


def test_groups_go_on_from_a_state(spark, tmp_path):
    """Files added later join the groups of earlier ones; only their rows are put on record."""
    docs, state = str(tmp_path / "docs"), str(tmp_path / "state")
    texts = [["a b", "c", "ab"], ["c ", "d", " a  b "], ["ab", "e"]]
    for k, some in enumerate(texts):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(some)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs)
        found = exact_dedup.exact_groups(spark.read.parquet(docs), state=state).collect()
        rows = [(10 * j + i, t) for j, ts in enumerate(texts[: k + 1]) for i, t in enumerate(ts)]
        assert sorted((x["doc_id"], x["keep_id"], x["group_size"]) for x in found) == sorted(x[:3] for x in plain_groups(rows))
        assert spark.read.parquet(f"{state}/records").count() == len(rows)


def test_drop_rows(spark, docs):
    located = with_locator(docs)
    assert located.select("__wm_file", "__wm_row").distinct().count() == docs.count()
    written = drop_rows(file_backed(docs), docs.limit(0).selectExpr("1L as __wm_file", "1L as __wm_row"))
    assert written.columns == docs.columns and written.count() == docs.count()


@pytest.mark.parametrize("filter_bytes", [8, 1 << 20])
def test_drop_many_rows(spark, filter_bytes):
    """A filter that lets nearly all rows through to the join, and one that lets few."""
    rows = file_backed(spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text").repartition(3))
    located = with_locator(rows)
    for gone in ("doc_id % 3 = 0", "doc_id < 0", "doc_id >= 0"):
        left = drop_rows(rows, located.where(gone), filter_bytes)
        assert sorted(x[0] for x in left.collect()) == [x[0] for x in rows.where(f"not ({gone})").orderBy("doc_id").collect()]


# 6


def test_media_round_trip(docs, none, texts):
    made = media.encode_media(docs)
    found = {x["doc_id"]: x for x in media.media_digests(made).collect()}
    stored = {x["doc_id"]: bytes(x["media"]) for x in made.collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        x = found[k]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert x["tail_crc32"] == zlib.crc32(payload[-32:]) and x["media_bytes"] == len(stored[k]) and x["media_sha256"] == hashlib.sha256(stored[k]).hexdigest()
    assert found[25]["feature"] == next(x["feature"] for k, x in found.items() if k and k > 80 and texts[k] == texts[25])
    assert media.media_digests(media.encode_media(none)).count() == 0
    packets = media.packet_table(made).where("doc_id = 80").orderBy("packet").collect()
    data = stored[80]
    assert b"".join(data[p["offset"] : p["offset"] + p["size"]] for p in packets) == media.padded(texts[80])[1]
    assert [p["ticks"] for p in packets] == [72 * k for k in range(len(packets))] and {p["lacing"] for p in packets} >= {"xiph", "fixed", "ebml"}
    assert all(p["track"] == 1 and p["key"] for p in packets)


def test_clusters_and_cues():
    payload = bytes(range(256)) * 1350
    data = media.write_matroska(payload)
    found = media.read_matroska(data)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in found.packets) == payload
    assert [p[1] for p in found.packets] == [72 * k for k in range(600)] and len({p[6] for p in found.packets}) == 3
    assert [c[0] for c in found.cues] == [0, 256 * 72, 512 * 72] and all(data[c[2] : c[2] + 4] == media.id_bytes(media.CLUSTER) for c in found.cues)


def test_foreign_files(spark):
    e = media.element
    frames = [bytes([k]) * n for k, n in enumerate((3, 300, 255, 1, 700))]
    blocks = [
        e(media.SIMPLE_BLOCK, media.block_body(1, 5, frames, media.XIPH)),
        e(media.GROUP, e(0x9B, 4) + e(media.BLOCK, media.block_body(2, -3, frames, media.EBML_LACING)) + e(media.REFERENCE, 1)),
        e(media.GROUP, e(media.BLOCK, media.block_body(2, 7, [b"zz", b"yy"], media.FIXED, key=False))),
        e(0xEC, b"void") + e(media.SIMPLE_BLOCK, media.block_body(200, 9, [b"solo"], media.NO_LACING, key=False)),
    ]
    tracks = e(media.TRACKS, e(media.TRACK, e(media.NUMBER, 1) + e(media.CODEC, "x") + e(media.DEFAULT_DURATION, 2_000_000)))
    unknown = b"\x01" + b"\xff" * 7
    body = e(media.INFO, e(media.SCALE, 1_000_000)) + tracks + media.id_bytes(media.CLUSTER) + unknown + e(media.CLUSTER_TIME, 100) + b"".join(blocks) + media.id_bytes(media.CLUSTER) + unknown + e(media.CLUSTER_TIME, 200) + blocks[3]
    body += e(media.CUES, e(media.CUE, e(media.CUE_TIME, 100) + e(media.CUE_POSITIONS, e(media.CUE_TRACK, 1) + e(media.CUE_CLUSTER, 30))))
    data = e(media.EBML, e(media.DOC_TYPE, "webm")) + media.id_bytes(media.SEGMENT) + unknown + body
    found = media.read_matroska(data)
    assert [data[p[2] : p[2] + p[3]] for p in found.packets] == [*frames, *frames, b"zz", b"yy", b"solo", b"solo"]
    assert [p[1] for p in found.packets] == [105, 107, 109, 111, 113, *[97] * 5, 107, 107, 109, 209]
    assert [p[4] for p in found.packets] == [True] * 5 + [False] * 5 + [True] * 2 + [False] * 2
    assert found.cues[0][:2] == (100, 1) and {p[0] for p in found.packets} == {1, 2, 200}
    for bad in (None, b"", b"RIFF", data[:40], data[:200]):
        media.read_matroska(bad)
    df = spark.createDataFrame([(1, data), (2, None), (3, b"junk")], "doc_id long, media binary")
    assert media.packet_table(df).count() == 14


def test_cut_and_corrupted_files(spark):
    """A file cut at every length gives the packets that are whole; changed bytes never crash."""
    r = random.Random(41)
    payload = bytes(r.randrange(256) for _ in range(576 * 19))
    data = media.write_matroska(payload)
    whole = media.read_matroska(data).packets
    before = 0
    for n in range(len(data)):
        found = media.read_matroska(data[:n]).packets
        assert found == whole[: len(found)] and len(found) >= before
        before = len(found)
    assert before == len(whole)
    head = 300
    cases = []
    for _ in range(4000):
        bad = bytearray(data[: r.choice((head, 2000, len(data)))])
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(min(len(bad), r.choice((60, head, len(data)))))] = r.choice((0, 255, 1, 0x80, 0xA3, 0x1F, r.randrange(256)))
        cases.append(bytes(bad))
    for unknown in (b"\xff", b"\x01" + b"\xff" * 7):
        cases += [media.id_bytes(media.EBML) + b"\x80" + (media.id_bytes(kind) + unknown) * 5000 for kind in (media.SEGMENT, media.CLUSTER, media.GROUP, media.SIMPLE_BLOCK)]
    for bad in cases:
        for track, _, at, size, *_ in media.read_matroska(bad).packets:
            assert 0 <= at and 0 <= size and at + size <= len(bad)
    zero = data.replace(media.element(media.SCALE, 1_000_000), media.element(media.SCALE, 0) + b"\xec\x80")
    huge = media.id_bytes(media.EBML) + b"\x80" + media.element(media.SEGMENT, media.element(media.INFO, media.element(media.SCALE, 2**62)) + media.element(media.CLUSTER, media.element(media.CLUSTER_TIME, 2**63 - 1) + media.element(media.SIMPLE_BLOCK, media.block_body(1, 5, [b"x"], media.NO_LACING))))
    rows = [(k, 0, b) for k, b in enumerate([None, b"", b"junk", zero, huge, *cases[:200], *cases[-8:]])]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {x["doc_id"]: x for x in media.media_digests(df).collect()}
    assert len(got) == len(rows) and got[0]["media_sha256"] is None and got[0]["payload_bytes"] == 0
    assert got[1]["media_bytes"] == 0 and got[1]["feature"].startswith("packets=0;")
    packets = media.packet_table(df).collect()
    assert {x["doc_id"] for x in packets} >= {3, 4} and [x["ticks"] for x in packets if x["doc_id"] == 4] == [None]


# 7


def plain_verdict(url, block, allow, labels):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(h, p) for h, p in block + allow if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        h, p = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])))
        return host, path, h + p, "allow" if (h, p) in allow else "block"
    return host, path, None, "block" if set(re.split(r"[.\-]", host)) & set(labels) else "allow"


def test_urls(spark):
    r = random.Random(9)
    block, allow = [("net", "/"), ("example.com", "/de/"), ("a.org", "")], [("example.net", "/en/"), ("org", "/fr/")]
    urls = [None, "", "x", "http://", "://net/", "HTTP://Example.NET/EN/", "http://example.net/en/1?q#f", "http://example.net", "http://notexample.net/en/", "http://b.a.org", "ftp://x.ORG/fr/?a", "http://net", "http://net/", "http://a.b.example.com/de/x/y", "http://x.com?://net/", "http://free-bets.x.com/", "http://Kelvin.net/", "http://..net/"]
    for _ in range(3000):
        host = ".".join(r.choice(("a", "b", "example", "net", "org", "com", "ads", "x-track")) for _ in range(r.randint(1, 5)))
        urls.append(f"{r.choice(('http', 'https'))}://{host}{r.choice(('', '/', '/en/', '/de/', '/fr/', '/en', '/e'))}{r.choice(('', 'p', '?x=/fr/', '#y'))}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as html", "'y' as host", "'z' as rule")
    # few bits a key, so that several levels are needed
    for sizes in ({}, {"bits_per_key": 6, "hashes": 2}):
        found = url_filter.judge_urls(pages, block, allow, ("ads", "track"), **sizes).collect()
        assert len(found) == len(urls)
        for x in found:
            assert (x["host"], x["path"], x["rule"], x["verdict"]) == plain_verdict(urls[x["page_id"]], block, allow, ("ads", "track"))
    assert url_filter.judge_urls(pages.limit(0), block, allow).count() == 0
    assert {x["verdict"] for x in url_filter.judge_urls(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    listed = spark.range(500).selectExpr("concat('k', id) as key")
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(listed, universe, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 2
    got = {x["key"] for x in universe.where(url_filter.contains(F.col("key"), cascade)).collect()}
    assert got == {f"k{i}" for i in range(500)}
    assert url_filter.build_cascade(listed, universe, max_bytes=10) is None
    one_bit = url_filter.build_cascade(listed, universe, bits_per_key=1, hashes=1)  # hardly a filter, but it ends
    assert {x["key"] for x in universe.where(url_filter.contains(F.col("key"), one_bit)).collect()} == got


def test_long_lists(spark):
    """200,000 listed keys, as one literal and, beyond the bound, by a join."""
    block = [(f"h{k}.example.com", "/") for k in range(200_000)]
    urls = [f"http://{a}h{k}.example.com/x" for k in (0, 5, 199_999, 200_000, 300_000) for a in ("", "w.", "a.b.")] * 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for sizes in ({}, {"max_bytes": 1000}):
        found = url_filter.judge_urls(pages, block, [("example.com", "/y")], ("w",), **sizes).collect()
        assert len(found) == len(urls)
        for x in found:
            n = int(re.search(r"h(\d+)\.", urls[x["page_id"]])[1])
            assert x["rule"] == (f"h{n}.example.com/" if n < 200_000 else None)
            assert x["verdict"] == ("block" if n < 200_000 or "w." in urls[x["page_id"]] else "allow")


def test_urls_of_many_labels(spark):
    hosts = ["a." * 30_000 + "net", "x" * 100_000, "." * 50_000, "a." * 20_000 + "example.com"]
    pages = spark.createDataFrame([(k, f"http://{h}/de/" + "p" * 50_000) for k, h in enumerate(hosts)], "page_id long, url string")
    began = time.monotonic()
    found = {x["page_id"]: x for x in url_filter.judge_urls(pages, [("net", "/"), ("example.com", "/de/")], [("org", "")], ("ads",)).collect()}
    assert [found[k]["rule"] for k in range(4)] == ["net/", None, None, "example.com/de/"]
    assert time.monotonic() - began < 60


# 8


def plain_fingerprint(text, size, table=0):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", simhash.lower_ascii(text or "")) if w]
    shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    if table:
        h = [((x ^ x >> 33) * 0x9E3779B97F4A7C15 * (2 * table + 1)) % 2**64 for x in h]
        h = [x ^ x >> 29 for x in h]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(fps):
    """Components of fingerprints, or of rows of one fingerprint a table."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if any((x ^ y).bit_count() <= 2 for x, y in (zip(a, b) if isinstance(a, tuple) else [(a, b)])):
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("limit", [64, 1])
def test_near_duplicates(docs, none, texts, limit):
    found = simhash.near_duplicates(docs, pair_limit=limit).collect()
    assert len(found) == docs.count()
    fps = {r["doc_id"]: plain_fingerprint(r["text"], 3) for r in docs.select("doc_id", "text").collect()}
    root = plain_components(set(fps.values()))
    smallest = {}
    for k, f in fps.items():
        if k is not None:
            smallest[root[f]] = min(k, smallest.get(root[f], k))
    for x in found:
        assert x["fp"] % 2**64 == fps[x["doc_id"]] and x["component_id"] == smallest.get(root[fps[x["doc_id"]]])
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_by_tables(spark):
    r = random.Random(13)
    rows = []
    for _ in range(25):
        words = [f"w{r.randrange(500)}" for _ in range(300)]
        for _ in range(r.choice((1, 4))):
            words[r.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {k: tuple(plain_fingerprint(t, 5, n) for n in range(8)) for k, t in rows}
    root = plain_components(set(fps.values()))
    want = {k: min(j for j in fps if root[fps[j]] == root[fps[k]]) for k in fps}
    for limit in (64, 2):
        assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, size=5, tables=8, pair_limit=limit).collect()} == want
    one = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, size=5).collect()}
    assert len(set(want.values())) < len(set(one.values()))


@pytest.mark.parametrize("limit", [64, 3])
def test_links_miss_nothing(spark, limit):
    r = random.Random(12)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice((1, 3, 30))):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, 0, f) for f in signed], "node long, tab int, value long")
    got = {x["node"] % 2**64: x["root"] % 2**64 for x in simhash.components(simhash.links(nodes, limit)).collect()}
    root = plain_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(root[f], set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_golay_tables():
    parts, near, table = simhash.golay()
    assert sorted(map(len, near)) == [1] * 277 + [6] * 1771
    assert all(bin(p).count("1") <= 4 for ps in near for p in ps)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    assert {got[k] for k in range(301)} == {0} and got[1001] == got[1000] == 1000


# 10


def test_chats(spark):
    said = "</s>[INST] ok [/INST]"
    odd = ["<|turn|>user\nhi<|end|>\n", "<|next|>", "&lt;|next|>&amp;", "", None, "é🙂\n", said, "a<b&c"]
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["system", "user", "user", "assistant", "assistant", None, "user", "assistant"], odd))]
    rows += [(2, 0, "assistant", None), (3, None, "r\n<", "x"), (3, 1, "r\n<", "y"), (None, 0, "user", "n"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "b")]
    rows += [(5, k, "user" if k % 3 else "assistant", f"t{k}<") for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as turns", "1 as t")
    chats = chat.format_chats(turns)
    found = {x["conv_id"]: x for x in chat.read_turns(chats, "formatted").collect()}
    masks = {x["conv_id"]: x for x in chats.collect()}
    for conv in (1, 2, 3, 4, 5, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in mine]
        x = found[conv]
        assert [tuple(t) for t in x["turns"]] == want
        loss = [t for role, t in want if role == "assistant"]
        assert "".join(x["loss_texts"]) == "".join(loss)
        # the mask as it stands: skip and take over the formatted text
        at, taken = 0, []
        for m in masks[conv]["loss_mask"]:
            at += m["skip"]
            taken.append(x["formatted"][at : at + m["take"]])
            at += m["take"]
        assert "".join(taken).replace("&lt;", "<").replace("&amp;", "&") == "".join(loss)
        runs = len(list(itertools.groupby(want, key=lambda t: t[0])))
        assert x["formatted"].count("<|turn|>") == x["formatted"].count("<|end|>") == runs and x["formatted"].count("<|next|>") == len(want) - runs
    assert chat.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("wrong", ["struct(x.skip + 1 as skip, x.take as take)", "struct(x.skip - 1 as skip, x.take + 1 as take)", "struct(x.skip + 1 as skip, x.take - 1 as take)"])
def test_loss_text_is_read_through_the_mask(spark, wrong):
    """A mask with other offsets gives another text, or none at all."""
    turns = spark.createDataFrame([(1, 0, "user", "hi <"), (1, 1, "assistant", "abc"), (1, 2, "assistant", "de"), (1, 3, "user", "x")], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns)
    assert chat.read_turns(chats).first()["loss_texts"] == ["abc", "de"]
    moved = chats.selectExpr("conv_id", "formatted", f"transform(loss_mask, (x, i) -> if(i = 1, {wrong}, x)) as loss_mask")
    try:
        assert "".join(chat.read_turns(moved).first()["loss_texts"]) != "abcde"
    except Exception as error:  # noqa: BLE001
        assert "in step" in str(error)
