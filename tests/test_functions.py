import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmap.functions.fnch import fnch_tail, fnch_tail_sql, upper_tail, upper_tails
from weftmap.functions.stats import is_close, log_ratio, odds_ratio
from weftmap.functions.text import pair_of_file, parse_range, parse_size, pretty_duration, pretty_size
from weftmap.sources.text import short_double


def exact_tail(n, n1, n2, total, odds):
    odds = max(Fraction(odds), Fraction(0.1))
    weights = {x: math.comb(n1, x) * math.comb(total - n1, n2 - x) * odds**x for x in range(max(0, n1 + n2 - total), min(n1, n2) + 1)}
    return float(sum(w for x, w in weights.items() if x >= n) / sum(weights.values()))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 90), st.floats(0.01, 8.0), st.integers(2, 60))
def test_tail_is_exact(n1, n2, more, odds, n):
    total = max(n1, n2) + more
    want = exact_tail(n, n1, n2, total, odds)
    assert upper_tail(n, n1, n2, total, odds) == pytest.approx(want, rel=1e-9, abs=1e-13)


def test_rows_in_lockstep():
    """Rows of a batch don't disturb each other, whatever their walks' lengths."""
    r = random.Random(7)
    rows = [(r.randint(1, 60), n1, n2, max(n1, n2) + r.randint(0, 90), r.uniform(0.01, 8)) for n1, n2 in ((r.randint(1, 60), r.randint(1, 60)) for _ in range(300))]
    rows += [(200_000, 1_000_000, 1_000_000, 5_000_000, 1.0), (3, 4, 4, 30, 0.01), (5000, 60_000, 70_000, 900_000, 1.1)]
    n, n1, n2, total, odds = (np.array(c) for c in zip(*rows))
    together = upper_tails(n, n1, n2, total, odds)
    assert together[-3:] == pytest.approx([upper_tail(*row) for row in rows[-3:]], rel=1e-12)
    for p, row in zip(together[:300], rows):
        assert p == pytest.approx(1.0 if row[0] == 1 else exact_tail(*row), rel=1e-9, abs=1e-13)
    assert len(upper_tails(*(np.empty(0, np.int64) for _ in range(4)), np.empty(0))) == 0


def test_tail_limits():
    assert upper_tail(1, 10, 10, 50, 1.0) == 1.0
    assert upper_tail(11, 10, 10, 50, 1.0) == 0.0
    assert 0 < upper_tail(900, 1000, 1000, 100_000, 1.0) < 1e-300 or upper_tail(900, 1000, 1000, 100_000, 1.0) == 0
    assert upper_tail(200_000, 1_000_000, 1_000_000, 5_000_000, 1.0) == pytest.approx(0.5, abs=0.01)
    with pytest.raises(OverflowError):
        upper_tail(3, 2**31, 5, 2**32, 1.0)


def test_kernel_and_expression_agree(spark):
    rows = [(2, 10, 12, 60, 1.0), (5, 40, 30, 200, 0.7), (9, 30, 30, 90, 2.5), (1, 5, 5, 20, 1.0), (None, 1, 1, 1, 1.0), (3, 4, 4, 30, 0.01)]
    df = spark.createDataFrame(rows, "n long, n1 long, n2 long, t long, w double")
    out = df.select("n", fnch_tail("n", "n1", "n2", "t", "w").alias("a"), fnch_tail_sql(*map(F.col, ("n", "n1", "n2", "t", "w"))).alias("b")).collect()
    for r, row in zip(out, rows):
        if row[0] is None:
            assert r["a"] is None and r["b"] is None
        else:
            assert r["a"] == pytest.approx(r["b"], rel=1e-9)
            assert r["a"] == pytest.approx(exact_tail(*row) if row[0] > 1 else 1.0, rel=1e-9)


def test_expression_is_exact(spark):
    """Odds on both sides of 1, supports that begin above 0 or hold one value, n on either side of the mode and beyond the support."""
    r = random.Random(11)
    rows = [(r.randint(1, 60), n1, n2, max(n1, n2) + r.randint(0, 90), 2 ** r.uniform(-5, 12)) for n1, n2 in ((r.randint(1, 60), r.randint(1, 60)) for _ in range(400))]
    rows += [(k, 60, 60, 60, 0.1) for k in (2, 60, 61)] + [(k, 60, 59, 61, w) for k in (57, 58, 59, 60) for w in (0.1, 1.0, 1e6)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, n long, n1 long, n2 long, t long, w double")
    out = {k: p for k, p in df.select("k", fnch_tail_sql(*map(F.col, ("n", "n1", "n2", "t", "w")))).collect()}
    for k, row in enumerate(rows):
        assert out[k] == pytest.approx(1.0 if row[0] == 1 else exact_tail(*row), rel=1e-9, abs=1e-13), row


def test_expression_on_large_margins(spark):
    """The expression takes the terms that matter, not the whole support, whose list doesn't fit a task here."""
    far, wide = 2**30, (2**31 - 1) // 4
    rows = [(wide + k, far, far, 2**31 - 1, 1.0) for k in (400_000, 20_000, 300, 0, -300, -30_000)]
    rows += [(200_000 + k, 1_000_000, 1_000_000, 5_000_000, w) for k in (-500, 0, 2_000, 9_000) for w in (0.3, 1.0, 1.01, 40.0)]
    rows += [(5000, 60_000, 70_000, 900_000, 1.1), (999_990, 1_000_000, 1_000_000, 1_000_020, 1.0), (3, 2_000_000, 40, 30_000_000, 2.0)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, n long, n1 long, n2 long, t long, w double")
    out = df.select("k", fnch_tail("n", "n1", "n2", "t", "w").alias("a"), fnch_tail_sql(*map(F.col, ("n", "n1", "n2", "t", "w"))).alias("b")).collect()
    for r in out:
        assert r["b"] == pytest.approx(r["a"], rel=1e-7, abs=1e-300), rows[r["k"]]
    assert len({r["b"] for r in out}) > 10


def test_ratios(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = lambda *xs: [F.lit(x) for x in xs]
    assert value(odds_ratio(*lit(2, 20, 5, 6))) == pytest.approx(2 * 11 / (3 * 4))
    assert math.isnan(value(odds_ratio(*lit(2, 20, 0, 6))))
    assert math.isnan(value(odds_ratio(*lit(float("nan"), 20.0, 5.0, 6.0))))
    assert value(odds_ratio(*lit(5, 20, 5, 6))) == math.inf
    assert value(odds_ratio(*lit(3_000_000_000, 9_000_000_000, 4_000_000_000, 4_000_000_000))) == pytest.approx(3e9 * 4e9 / 1e18)
    assert value(log_ratio(F.lit(8), F.lit(2.0))) == 2.0
    assert value(log_ratio(F.lit(8), F.lit(0.0))) == math.inf
    assert value(is_close(F.lit(1.0), F.lit(1.0 + 1e-8))) and not value(is_close(F.lit(1.0), F.lit(1.1)))


def test_text():
    assert parse_range("chr1:1,000-2,000") == ("chr1", 1000, 2000) and parse_range("all") is None
    for bad in ("chr1", "chr1:5-5", "chr1:9-3"):
        with pytest.raises(ValueError):
            parse_range(bad)
    assert parse_size("125MB", 125 * 10**6) == 125_000_000 and parse_size("1GiB") == 2**30
    with pytest.raises(ValueError):
        parse_size("1MB", 125 * 10**6)
    assert pretty_duration(0.25) == "250.000ms" and pretty_duration(61.5) == "1m:1.500s"
    assert pretty_size(1_500_000) == "1.50MB"


def test_columns_of_text(spark):
    values = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, -2.5, 1e-300, 3.14159265, float("nan"), float("inf"), 999999.5, 100000.0, 0.1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(short_double(F.col("x"))).collect()]
    assert got == ["%g" % v for v in values]
    a, b = pair_of_file(F.lit("/x/out.chr1.chr2.parquet"))
    assert tuple(spark.range(1).select(a, b).first()) == ("chr1", "chr2")
