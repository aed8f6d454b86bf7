"""Upper tail of Fisher's non-central hypergeometric distribution.

``P(X >= n)`` for margins n1, n2, total and odds: unnormalised probabilities follow from
their neighbours by ``f(x)/f(x-1) = (n1-x+1)(n2-x+1) odds / (x (total-n1-n2+x))``. With
``f(mode) = 1`` both walks away from the mode fall, so the terms that matter are summed
from the mode outwards until they are below a limit, and nothing overflows. The tail is
summed from n on in units of f(n), which keeps tiny p-values exact. The rows of a batch
walk in lockstep, as lines of one array.

``fnch_tail`` is the Arrow kernel; ``fnch_tail_sql`` the same sums as a Spark expression,
for checks.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_OMEGA = 0.1
INT32 = 2**31 - 1
#: Terms below this share of the largest one don't change a double.
SMALLEST = 1e-23
#: Terms a row gets at once, at first and at most, and cells that are worked on together.
FIRST_STEP, LAST_STEP, CELLS = 32, 4096, 1 << 20
#: Of 1/z, 1/z^3 and so on in the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


class Margins:
    """The arguments of many rows, as arrays."""

    def __init__(self, n1: np.ndarray, n2: np.ndarray, total: np.ndarray, odds: np.ndarray):
        self.n1, self.n2, self.rest, self.odds = n1, n2, total - n1 - n2, np.log(odds)
        self.low, self.high = np.maximum(0, n1 + n2 - total), np.minimum(n1, n2)

    def log_ratios(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """log f(x)/f(x-1), a line of x for each of rows; meaningless outside the support."""
        of = lambda v: v[rows][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(of(self.n1) - x + 1.0) + np.log(of(self.n2) - x + 1.0) + of(self.odds) - np.log(x) - np.log(of(self.rest) + x)

    def steps(self, begin: np.ndarray, end: np.ndarray, direction: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Walks of all rows from begin to end in lockstep: (rows, ratios of their next terms, which of these
        count, last one that does). What is sent back tells rows that need go no further."""
        at, live, width = begin.copy(), np.flatnonzero((end - begin) * direction > 0), FIRST_STEP
        while len(live):
            kept = []
            for k in range(0, len(live), max(1, CELLS // width)):
                rows = live[k : k + max(1, CELLS // width)]
                offset = np.arange(1, width + 1)[None, :]
                # going up, the ratio of the next term; going down, that of the present one, upside down
                x = (at[rows][:, None] + offset if direction > 0 else at[rows][:, None] - offset + 1).astype(np.float64)
                left = (end[rows] - at[rows]) * direction
                inside = offset <= left[:, None]
                last = np.minimum(left, width) - 1
                done = yield rows, np.where(inside, direction * self.log_ratios(rows, x), 0.0), inside, last
                at[rows] += direction * (last + 1)
                kept.append(rows[~done & ((end[rows] - at[rows]) * direction > 0)])
            live, width = np.concatenate(kept), min(2 * width, LAST_STEP)

    def sums(self, begin: np.ndarray, end: np.ndarray, direction: int) -> np.ndarray:
        """For each row the sum of f(x)/f(begin) for x after begin, up to end."""
        total, log_f = np.zeros(len(begin)), np.zeros(len(begin))
        walk = self.steps(begin, end, direction)
        step = next(walk, None)
        while step:
            rows, ratios, inside, last = step
            logs = log_f[rows][:, None] + np.cumsum(ratios, axis=1)
            total[rows] += np.where(inside, np.exp(logs), 0.0).sum(1)
            place = np.arange(len(rows))
            log_f[rows] = logs[place, last]
            # beyond the mode terms fall ever faster
            falling = (last > 0) & (ratios[place, last] < 0)
            try:
                step = walk.send(falling & (log_f[rows] < np.log(SMALLEST) + np.minimum(0.0, np.log1p(total[rows]))))
            except StopIteration:
                break
        return total

    def log_between(self, begin: np.ndarray, end: np.ndarray, direction: int) -> np.ndarray:
        """For each row log f(end)/f(begin)."""
        out = np.zeros(len(begin))
        walk = self.steps(begin, end, direction)
        step = next(walk, None)
        while step:
            rows, ratios, _, _ = step
            out[rows] += ratios.sum(1)
            try:
                step = walk.send(np.zeros(len(rows), bool))
            except StopIteration:
                break
        return out

    def mode(self) -> np.ndarray:
        odds = np.exp(self.odds)
        a, b, c = odds - 1.0, -((self.n1 + self.n2 + 2.0) * odds + self.rest), (self.n1 + 1.0) * (self.n2 + 1.0) * odds
        root = np.sqrt(np.maximum(b * b - 4 * a * c, 0.0))
        return np.clip(np.floor(2 * c / (root - b)), self.low, self.high).astype(np.int64)


def upper_tails(n: np.ndarray, n1: np.ndarray, n2: np.ndarray, total: np.ndarray, odds: np.ndarray, min_omega: float = MIN_OMEGA) -> np.ndarray:
    """P(X >= n) of each row; 1 for n = 1 by definition of the test."""
    if len(n) and max(n1.max(), n2.max(), total.max()) > INT32:
        raise OverflowError("margins beyond 2^31-1 can't be tested")
    every = Margins(n1, n2, total, np.maximum(odds, min_omega))
    out = np.where((n == 1) | (n <= every.low), 1.0, 0.0)
    open_ = np.flatnonzero((out == 0) & (n <= every.high))
    if not len(open_):
        return out
    n, m = n[open_], Margins(n1[open_], n2[open_], total[open_], np.maximum(odds[open_], min_omega))
    mode = m.mode()
    whole = 1.0 + m.sums(mode, m.high, 1) + m.sums(mode, m.low, -1)
    right = n > mode
    # right of the mode: in units of f(n); left of it the tail is large: take what is below n away from it
    from_n = 1.0 + m.sums(n, np.where(right, m.high, n), 1)
    below = 1.0 + m.sums(n - 1, np.where(right, n - 1, m.low), -1)
    at_n = m.log_between(mode, np.where(right, n, mode), 1) + m.log_between(mode, np.where(right, mode, n - 1), -1)
    with np.errstate(divide="ignore"):
        out[open_] = np.where(right, np.exp(at_n + np.log(from_n) - np.log(whole)), np.clip(1.0 - np.exp(at_n) * below / whole, 0.0, 1.0))
    return out


def upper_tail(n: int, n1: int, n2: int, total: int, odds: float, min_omega: float = MIN_OMEGA) -> float:
    """upper_tails of one row."""
    return float(upper_tails(*(np.array([v], np.int64) for v in (n, n1, n2, total)), np.array([odds], np.float64), min_omega)[0])


def _tails(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        table = pa.table(list(batch), names=["n", "n1", "n2", "total", "odds"])
        # counts are small integers and trans rows share their odds, so many rows have equal arguments
        each = table.drop_null().group_by(table.column_names).aggregate([])
        found = upper_tails(*(each[c].to_numpy().astype(np.float64 if c == "odds" else np.int64) for c in table.column_names))
        place = table.append_column("row", pa.array(range(len(table)), pa.int64()))
        joined = place.join(each.append_column("p", pa.array(found)), table.column_names).sort_by("row")
        yield joined["p"].combine_chunks()


def fnch_tail(n: Column, n1: Column, n2: Column, total: Column, odds: Column) -> Column:
    """P(X >= n) by the Arrow kernel; null where any argument is null."""
    return F.arrow_udf(_tails, T.DoubleType())(n, n1, n2, total, odds)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once a row, not wherever it stands."""
    return F.transform(F.array(value), of)[0]


def _log_factorials(a: Column, d: Column) -> Column:
    """log (a+d)!/a! + d, by Stirling's series 8 places further up; differences are taken before they are multiplied, so
    nothing is lost at large arguments."""
    z, shift = a + 8, F.log1p(d / (a + 8))
    series = lambda z: reduce(lambda acc, c: acc / (z * z) + c, [F.lit(c) for c in reversed(STIRLING)]) / z
    skipped = reduce(operator.mul, [(a + d + k) / (a + k) for k in range(1, 8)])
    return (z - 0.5) * shift + d * F.log(z + d) + series(z + d) - series(z) - F.log(skipped)


def fnch_tail_sql(n: Column, n1: Column, n2: Column, total: Column, odds: Column) -> Column:
    """The same by Spark's own functions, which can't leave a walk early: its length is worked out before.

    log f is concave: from the mode outwards, the logarithm of f(x)/f(x-1) falls at each step by at
    least 1/x + 1/(n1-x+1), and so for the other factors.
    """
    to = lambda c: c.cast("double")
    rest = to(total) - to(n1) - to(n2)
    given = F.struct(
        to(n).alias("n"), to(n1).alias("n1"), to(n2).alias("n2"), rest.alias("rest"), F.greatest(odds, F.lit(MIN_OMEGA)).alias("w"),
        F.greatest(F.lit(0.0), -rest).alias("low"), to(F.least(n1, n2)).alias("high"),
    )
    value = _let(given, lambda v: F.when(v["n"] <= v["low"], 1.0).when(v["n"] > v["high"], 0.0).otherwise(_let(_mode(v), lambda mode: _open_tail(v, mode))))
    known = reduce(operator.and_, [c.isNotNull() for c in (n, n1, n2, total, odds)])
    return F.when(known, F.when(n == 1, F.lit(1.0)).otherwise(value))


def _mode(v: Column) -> Column:
    a, b, c = v["w"] - 1, -((v["n1"] + v["n2"] + 2) * v["w"] + v["rest"]), (v["n1"] + 1) * (v["n2"] + 1) * v["w"]
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    # b is positive for odds below 1 only
    place = F.when(b > 0, (b + root) / (-2 * a)).otherwise(2 * c / (root - b))
    return F.greatest(v["low"], F.least(v["high"], F.floor(place).cast("double")))


def _open_tail(v: Column, mode: Column) -> Column:
    """P(X >= n) of a row whose n is above the least value and not above the greatest."""
    over = lambda x: (v["n1"] - x + 1) * (v["n2"] - x + 1) * v["w"]
    under = lambda x: x * (v["rest"] + x)

    def reach(ahead: Column, behind: Column, first: Column) -> Column:
        """Terms after which f is below SMALLEST of its value at the start; first: the first one's share of it."""
        most = -math.log(SMALLEST)
        by_slope = F.least(F.sqrt(2 * most * (ahead + 1)), most + F.sqrt(most**2 + 2 * most * (behind + 2)), F.when(first < 1, -most / F.log(first)))
        return F.least(ahead, F.ceil(by_slope).cast("double") + 2)

    def walk(far: Column, near: Column, step: int, share: Callable[[Column], Column]) -> Column:
        """1 + share(near) (1 + share(next) (...)): inwards, as one product and one sum a term."""
        places = F.sequence(far.cast("long"), near.cast("long"), F.lit(step).cast("long"))
        return F.aggregate(places, F.lit(0.0), lambda acc, x: acc * share(x.cast("double")) + 1)

    def up(x: Column) -> Column:
        """The sum of f from x on, in units of f(x); x at the mode or right of it."""
        end = x + reach(v["high"] - x, x - v["low"], over(x + 1) / under(x + 1))
        return walk(end + 1, x + 1, -1, lambda x: over(x) / under(x))

    def down(x: Column) -> Column:
        end = x - reach(x - v["low"], v["high"] - x, under(x) / over(x))
        return walk(end, x, 1, lambda x: under(x) / over(x))

    def height(x: Column) -> Column:
        """log f(x)/f(mode); what the parts have beyond the factorials, d and -d twice, cancels."""
        d = x - mode
        parts = _log_factorials(mode, d), _log_factorials(v["rest"] + mode, d), _log_factorials(v["n1"] - mode, -d), _log_factorials(v["n2"] - mode, -d)
        return d * F.log(v["w"]) - reduce(operator.add, parts)

    whole = up(mode) + down(mode) - 1
    above = lambda whole: F.exp(height(v["n"]) + F.log(up(v["n"])) - F.log(whole))
    below = lambda whole: F.exp(height(v["n"] - 1)) * down(v["n"] - 1) / whole
    # as in upper_tails
    return _let(whole, lambda whole: F.when(v["n"] > mode, above(whole)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - below(whole)))))
