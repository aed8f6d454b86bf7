"""Statistics as column expressions. Divisions are guarded: Spark's ANSI mode raises on zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: 0/0 is NaN, x/0 is infinite."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def odds_ratio(n: Column, total: Column, sum1: Column, sum2: Column) -> Column:
    """n (T-s1-s2+n) / ((s1-n)(s2-n)); NaN if n is NaN or a sum is 0, possibly infinite.

    In doubles throughout, as a product of large counts would overflow a long.
    """
    n, total, sum1, sum2 = (x.cast("double") for x in (n, total, sum1, sum2))
    value = ratio(n * (total - sum1 - sum2 + n), (sum1 - n) * (sum2 - n))
    return F.when(F.isnan(n) | (sum1 == 0) | (sum2 == 0), F.lit(NAN)).otherwise(value)


def log2_or_inf(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log2(x))


def log_ratio(observed: Column, expected: Column) -> Column:
    return log2_or_inf(observed) - log2_or_inf(expected)


def is_close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal up to a relative tolerance; NaNs are equal to each other."""
    return (F.isnan(a) & F.isnan(b)) | (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def significance(observed: Column, expected: Column, is_cis: Column, total: Column, n1: Column, n2: Column, exp_total: Column, l1: Column, l2: Column) -> dict[str, Column]:
    """odds_ratio, omega, log_ratio and whether the p-value needs the kernel.

    Observations of 0 and rows on a masked side (null sums) have 0 for all three. Without
    the kernel the p-value is 1.
    """
    none = (observed == 0) | n1.isNull() | n2.isNull()
    odds = odds_ratio(observed, F.when(is_cis, total).otherwise(2 * total), n1, n2)
    omega = F.when(is_cis, odds_ratio(expected, exp_total, l1, l2)).otherwise(F.lit(1.0))
    zero = F.lit(0.0)
    odds, omega = F.when(none, zero).otherwise(odds), F.when(none, zero).otherwise(omega)
    return {
        "odds_ratio": odds,
        "omega": omega,
        "log_ratio": F.when(none, zero).otherwise(log_ratio(observed, expected)),
        "tested": ~none & finite(odds) & finite(omega) & (omega <= odds) & (observed > 1),
    }
