import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmap.model import COORDINATES, UNBOUNDED, Genome, Params
from weftmap.operators import domains as dom
from weftmap.operators import marginals as mg
from weftmap.operators import masking, pixels
from weftmap.operators.expected import expected_values, pool, smooth
from weftmap.operators.fdr import benjamini_hochberg

PIXELS = "chrom1 string, chrom2 string, b1 long, b2 long, n long"
ROWS = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long"


def rows(df):
    return sorted(map(tuple, df.collect()))


# correction


def corrected(spark, ps, **more):
    df = spark.createDataFrame([("a", k, k + 1, "a", k, k + 1, float(p)) for k, p in enumerate(ps)], f"{ROWS}, pvalue double")
    return [r["pvalue_corrected"] for r in benjamini_hochberg(df, **more).orderBy("start1").collect()]


VECTORS = [
    ([0.25, 0, 1 / 12, 1 / 6, 1 / 18, 1 / 9, 5 / 36, 1 / 36, 7 / 36, 2 / 9], [0.25, 0, 0.2083333, 0.2380952, 0.1851852, 0.2222222, 0.2314815, 0.1388889, 0.2430556, 0.2469136]),
    ([0.05, 0.05, 0.1, 0], [0.0666667, 0.0666667, 0.1, 0]),
    ([0.05, 0.1, 0], [0.075, 0.1, 0]),
]


@pytest.mark.parametrize("window_bytes", [1 << 30, -1])
def test_bh_vectors(spark, window_bytes):
    for ps, want in VECTORS:
        for method in ("reference", "textbook"):
            assert corrected(spark, ps, by="all", method=method, window_bytes=window_bytes) == pytest.approx(want, abs=1e-6)
    assert corrected(spark, [0.01, 0.011, 0.012, 0.9], window_bytes=window_bytes) == pytest.approx([0.022, 0.016, 0.016, 0.9])
    assert corrected(spark, [0.04, 0.041, 0.042], window_bytes=window_bytes) == pytest.approx([0.0615, 0.042, 0.042])
    assert corrected(spark, [0.04, 0.041, 0.042], method="textbook", window_bytes=window_bytes) == pytest.approx([0.042] * 3)
    assert corrected(spark, [0.7], window_bytes=window_bytes) == [0.7]
    assert corrected(spark, [], window_bytes=window_bytes) == []


def test_bh_ways_agree_on_groups(spark):
    r = random.Random(3)
    data = [(r.choice("ab"), k, k + 1, r.choice("ab"), k, k + 1, round(r.random(), 2)) for k in range(500)]
    df = spark.createDataFrame(data, f"{ROWS}, pvalue double")
    for by, method in itertools.product(("all", "cis-trans", "chrom-chrom"), ("reference", "textbook")):
        one, other = (rows(benjamini_hochberg(df, by, method, window_bytes=w)) for w in (1 << 30, -1))
        assert len(one) == 500
        for x, y in zip(one, other):
            assert x[:7] == y[:7] and x[7] == pytest.approx(y[7])
    with pytest.raises(ValueError):
        benjamini_hochberg(df, "nothing")


# marginals


def test_cis_marginals(spark):
    g = Genome((("chr1", 15),), 5)
    px = spark.createDataFrame([("chr1", "chr1", a, b, 1) for a, b in ((0, 0), (0, 2), (1, 1), (2, 2))], PIXELS)
    assert rows(mg.totals(px)) == [("chr1", "chr1", 5, 5)]
    assert [r[4] for r in rows(mg.marginals(px))] == [2, 1, 2]
    banded = px.where(pixels.in_band(g, 1, 100))
    assert rows(mg.totals(banded)) == [("chr1", "chr1", 2, 2)]
    assert rows(mg.marginals(banded)) == [("chr1", "chr1", 1, 0, 1), ("chr1", "chr1", 1, 2, 1)]
    assert rows(mg.totals(px.limit(0))) == []
    assert rows(mg.totals_of_marginals(mg.marginals(px), total="m")) == [("chr1", "chr1", 5)]


def test_trans_marginals(spark):
    g = Genome((("chr1", 15), ("chr2", 10)), 5)
    px = spark.createDataFrame([("chr1", "chr2", 0, 0, 1), ("chr1", "chr2", 1, 0, 10), ("chr1", "chr2", 1, 1, 1)], PIXELS)
    assert rows(mg.marginals(px)) == [("chr1", "chr2", 1, 0, 1), ("chr1", "chr2", 1, 1, 11), ("chr1", "chr2", 2, 0, 11), ("chr1", "chr2", 2, 1, 1)]
    assert rows(mg.nnz_average(mg.totals(px))) == [("chr1", "chr2", 4.0)]
    assert px.where(pixels.in_band(g, 1, 100)).count() == 3
    found = expected_values(px, g, Params(mad_max=0), kind="trans")
    assert rows(found.trans) == [("chr1", "chr2", 4.0)] and found.weights is None


def test_nan_counts(spark):
    px = spark.createDataFrame([("a", "a", 0, 1, 2.0), ("a", "a", 1, 1, math.nan)], PIXELS.replace("n long", "n double"))
    assert rows(mg.totals(px)) == [("a", "a", 4.0, 3)]
    assert rows(mg.marginals(px)) == [("a", "a", 1, 0, 2.0), ("a", "a", 1, 1, 2.0)]
    assert pixels.drop_nan_counts(px).count() == 1


# masks


def plain_mad(m, k):
    if not any(m):
        return [True] * len(m)
    if k == 0:
        return [False] * len(m)
    x = np.array(m) / np.median([v for v in m if v > 0])
    logs = np.log(x[x > 0])
    cut = math.exp(np.median(logs) - k * np.median(abs(logs - np.median(logs))))
    return [bool(v < cut) for v in x]


def test_mad_mask(spark):
    g = Genome((("a", 95), ("b", 40), ("All", 7)), 10)
    r = random.Random(1)
    data = [("a", "a", i, j, r.choice((1, 2, 50))) for i in range(10) for j in range(i, 10) if i != 4 and j != 4] + [("a", "b", 3, 2, 5), ("a", "b", 3, 1, 5), ("a", "b", 2, 1, 1)]
    px = spark.createDataFrame(data, PIXELS)
    for k in (0.0, 0.5, 2.0):
        got = {tuple(x) for x in masking.mad_mask(mg.marginals(px), g, k).collect()}
        want = set()
        for a, b in g.pairs():
            for side, c in ((1, a), (2, b)) if a != b else ((1, a),):
                m = [0] * g.bins(c)
                for c1, c2, i, j, n in data:
                    if (c1, c2) == (a, b):
                        if a == b:
                            m[i] += n
                            m[j] += n if i != j else 0
                        else:
                            m[i if side == 1 else j] += n
                want |= {(a, b, side, i) for i, bad in enumerate(plain_mad(m, k)) if bad}
        assert got == want


def test_masked_pixels_go(spark):
    g = Genome((("a", 50), ("b", 50)), 10)
    px = spark.createDataFrame([("a", "a", 0, 1, 1), ("a", "a", 1, 2, 1), ("a", "b", 0, 0, 1), ("a", "b", 2, 0, 1)], PIXELS)
    user = spark.createDataFrame([("a", 0)], "chrom string, b long")
    mask = masking.seed_mask(user, g)
    assert rows(pixels.drop_masked(px, mask, g)) == [("a", "a", 1, 2, 1), ("a", "b", 2, 0, 1)]
    assert pixels.drop_masked(px, None, g) is px
    assert rows(masking.union_masks(mask, mask)) == rows(mask)


# profile repair


def plain_pool(pos, obs, cp, co):
    pos, obs, m = list(pos), list(obs), len(obs)
    i = next((k for k, v in enumerate(obs) if v), None)
    if i is None:
        return pos, [math.nan] * m, 0
    k = max(j for j, v in enumerate(obs) if v)
    last, end = (m if k == m - 1 else k + 2), 0
    for i in range(i, m):
        p, o, j, cnt = pos[i], obs[i], 1, 1
        while (p < cp or o < co) and i >= j and i + j < m:
            p += pos[i - j] + pos[i + j]
            o += obs[i - j] + obs[i + j]
            cnt += 2
            j += 1
        if p >= cp or o >= co:
            end = i + j
            pos[i], obs[i] = p / cnt, o / cnt
    end = min(end, last)
    return pos, obs[:end] + [math.nan] * (m - end), end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(0, 40), st.integers(0, 40))
def test_pool(obs, cp, co):
    pos = np.arange(len(obs), 0, -1).astype(float)
    got_p, got_o = pos.copy(), np.array(obs, float)
    end = pool(got_p, got_o, cp + 0.5, co + 0.5)
    want_p, want_o, want_end = plain_pool(pos, obs, cp + 0.5, co + 0.5)
    if any(obs):
        np.testing.assert_allclose(got_p, want_p)
    np.testing.assert_allclose(got_o, want_o)
    assert end == want_end


def plain_smooth(w, q, bins):
    w, arm = list(w), bins // 2
    if bins < 2:
        return w
    for i in range(arm, len(w) - arm):
        frame = sorted(v for v in w[i - arm : i + arm + 1] if math.isfinite(v))
        if math.isfinite(w[i]) and w[i] > frame[int(q * (len(frame) - 1))]:
            w[i] = float(np.median(frame))
    return w


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 10), st.just(math.nan)), min_size=1, max_size=30), st.floats(0, 1), st.integers(0, 9))
def test_smooth(w, q, bins):
    got = np.array(w)
    smooth(got, q, bins)
    np.testing.assert_allclose(got, plain_smooth(w, q, bins))


# domains


def overlap(spark, g, rects, px):
    d = spark.createDataFrame(rects, ROWS)
    return {tuple(r)[:6]: r["obs"] for r in dom.overlap_sums(spark.createDataFrame(px, PIXELS), d, g).collect()}


def test_overlap_on_the_diagonal(spark):
    g = Genome((("c", 100),), 5)
    spans = [(10, 20), (15, 25), (20, 30), (50, 60)]
    rects = [("c", s, e, "c", s, e) for s, e in spans]
    found = overlap(spark, g, rects, [("c", "c", 10, 10, 1), ("c", "c", 12, 12, 1), ("c", "c", 2, 2, 3), ("c", "c", 3, 3, 7)])
    assert [found[r] for r in rects] == [10, 7, 0, 1]


def test_overlap_against_brute_force(spark):
    r = random.Random(5)
    g = Genome((("c", 97), ("d", 60)), 10)
    rects, px = set(), {}
    for _ in range(60):
        a, b = sorted((r.choice("cd"), r.choice("cd")))
        s1, s2 = r.randrange(0, 80), r.randrange(0, 50)
        rects.add((a, s1, s1 + r.randrange(1, 30), b, s2, s2 + r.randrange(1, 30)))
    for _ in range(80):
        a, b = sorted((r.choice("cd"), r.choice("cd")))
        i, j = r.randrange(g.bins(a)), r.randrange(g.bins(b))
        px[(a, b, *(sorted((i, j)) if a == b else (i, j)))] = r.randrange(1, 9)
    found = overlap(spark, g, sorted(rects), [(*k, n) for k, n in px.items()])
    for rect in rects:
        want = 0
        for (a, b, i, j), n in px.items():
            for x, y in {(i, j), (j, i)} if a == b else {(i, j)}:
                if (a, b) == (rect[0], rect[3]) and x * 10 < rect[2] and (x + 1) * 10 > rect[1] and y * 10 < rect[5] and (y + 1) * 10 > rect[4]:
                    want += n
        assert found[rect] == want


def test_product_and_dedup(spark):
    g = Genome((("b", 100), ("a", 100)), 10)
    beds = [("a", 0, 10), ("b", 5, 9), ("a", 20, 30), ("a", 0, 10), ("zzz", 1, 2)]
    d = spark.createDataFrame(beds, "chrom string, start long, end long")
    assert dom.distinct_domains(d).count() == 4
    assert rows(dom.domain_product(d, g)) == sorted(
        [("a", 0, 10, "a", 0, 10), ("a", 0, 10, "a", 20, 30), ("a", 20, 30, "a", 20, 30), ("b", 5, 9, "b", 5, 9), ("b", 5, 9, "a", 0, 10), ("b", 5, 9, "a", 20, 30)]
    )
    assert dom.domain_product(d, g, "trans").count() == 2 and dom.domain_product(d, g, "cis").count() == 4
    assert rows(dom.select_chroms(dom.domain_product(d, g), "b")) == [("b", 5, 9, "b", 5, 9)]


def test_coverage(spark):
    g = Genome((("c", 400_000),), 10_000)
    d = spark.createDataFrame([("c", 0, 100_000, "c", 150_000, 250_000)], ROWS)
    assert rows(dom.coverage(d, g)) == [("c", "c", 2, 10, 0.2)]


def test_coverage_against_brute_force(spark):
    r = random.Random(8)
    g = Genome((("c", 950), ("d", 600)), 10)
    rects = []
    for _ in range(40):
        a, b = sorted((r.choice("cd"), r.choice("cd")))
        s1, s2 = r.randrange(0, 500), r.randrange(0, 500)
        rects.append((a, s1, s1 + r.randrange(1, 100), b, s2, s2 + r.randrange(1, 100)))
    cells = set()
    for a, s1, e1, b, s2, e2 in rects:
        for x in range(s1 // 50, (e1 - 1) // 50 + 1):
            for y in range(s2 // 50, (e2 - 1) // 50 + 1):
                cells.add((a, b, min(x, y), max(x, y)) if a == b else (a, b, x, y))
    found = dom.coverage(spark.createDataFrame(rects, ROWS), g, 50).collect()
    assert {(x["chrom1"], x["chrom2"]): x["covered"] for x in found} == {p: sum(c[:2] == p for c in cells) for p in {c[:2] for c in cells}}


def test_product_by_tiles(spark):
    g = Genome((("b", 100), ("a", 100)), 10)
    d = spark.createDataFrame([("a", 0, 10), ("b", 5, 9), ("a", 20, 30)], "chrom string, start long, end long")
    for kind in ("all", "cis", "trans"):
        assert rows(dom.domain_product(d, g, kind, tiles=1)) == rows(dom.domain_product(d, g, kind, tiles=7))


def test_masks_beyond_the_bound_are_counted(spark, monkeypatch):
    """A genome too large for a broadcast by its size alone, and a mask that is small, or isn't."""
    import weftmap.model as model

    g = Genome((("a", 50), ("b", 50)), 10)
    px = spark.createDataFrame([("a", "a", 0, 1, 1), ("a", "a", 1, 2, 1), ("a", "b", 0, 0, 1), ("a", "b", 2, 0, 1)], PIXELS)
    mask = masking.seed_mask(spark.createDataFrame([("a", 0)], "chrom string, b long"), g)
    for allowed in (64, 64 * 3, 1 << 20):
        monkeypatch.setattr(model, "BROADCAST_BYTES", allowed)
        assert rows(pixels.drop_masked(px, mask, g, settled=True)) == [("a", "a", 1, 2, 1), ("a", "b", 2, 0, 1)]


def test_compare(spark):
    from weftmap.plans.validate import compare

    cols = f"{ROWS}, n long, p double"
    a = spark.createDataFrame([("c", k, k + 1, "c", k, k + 1, k, 0.5) for k in range(5)], cols)
    b = spark.createDataFrame([("c", k, k + 1, "c", k, k + 1, k + (k == 2), 0.5 + 1e-9 + (k == 3)) for k in range(1, 6)], cols)
    assert [(x["start1"], x["status"], x["differing"]) for x in compare(a, b).orderBy("start1").collect()] == [(0, "missing", ""), (2, "different", "n"), (3, "different", "p"), (5, "unexpected", "")]
    assert compare(a, a).count() == 0


def test_genome():
    g = Genome((("a", 95), ("All", 5), ("b", 40)), 10)
    assert g.pairs() == [("a", "a"), ("a", "b"), ("b", "b")] and g.pairs("trans") == [("a", "b")]
    assert (g.bins("a"), g.full_bins("a"), g.longest, g.ids) == (10, 9, 10, {"a": 0, "b": 2})
    assert g.side_rows() == 10 + 10 + 4 + 4
    for bad in (lambda: Genome((("a", 1), ("a", 2)), 1), lambda: Genome((), 0), lambda: Params(min_delta=5, max_delta=4), lambda: Params(mad_max=-1), lambda: Params(quantile=2)):
        with pytest.raises(ValueError):
            bad()
    assert Params().trans_only() == Params(min_delta=0, max_delta=UNBOUNDED, observed_cutoff=0, interpolate=False, quantile=0, window=0)


def test_range_scan(spark):
    g = Genome((("c", 100),), 10)
    px = spark.createDataFrame([("c", "c", i, j, 1) for i in range(10) for j in range(i, 10)], PIXELS)
    got = rows(pixels.scan_range(px, g, ("c", 15, 31), ("c", 50, 60)).select("b1", "b2"))
    assert got == [(1, 5), (2, 5), (3, 5)]
    assert pixels.scan_pair(px, "c").count() == 55 and pixels.pairs_present(px).count() == 1
    coords = rows(pixels.with_coordinates(px, g).where("b1 = 9").select(*COORDINATES))
    assert coords == [("c", 90, 100, "c", 90, 100)]


def test_whole_chromosome_test_skips_the_unusable(spark):
    from weftmap.plans.compute import compute

    g = Genome((("c", 100), ("d", 50)), 10)
    px = spark.createDataFrame([], PIXELS)
    assert compute(px, g).count() == 0
    one = spark.createDataFrame([("c", "c", 0, 5, 4), ("c", "d", 1, 1, 3)], PIXELS)
    assert compute(one, g, Params(mad_max=0, min_delta=10, observed_cutoff=0, interpolate=False)).where(F.col("pvalue") > 1).count() == 0
