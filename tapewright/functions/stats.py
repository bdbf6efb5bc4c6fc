"""Test statistics as aggregate expressions (mergeable, one pass)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _over(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def std_error(x: Column) -> Column:
    n = F.count(x)
    return F.when(n >= 2, F.stddev_samp(x) / F.sqrt(n))


def t_stat(x: Column) -> Column:
    return _over(F.avg(x), std_error(x))


def win_share(x: Column) -> Column:
    """Share of values strictly above zero; NULL without values."""
    return F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))


def mean_se_t(x: Column) -> dict[str, Column]:
    return {"n": F.count(x), "mean": F.avg(x), "se": std_error(x), "t": t_stat(x), "win": win_share(x)}


def welch_t(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Unequal-variance t; NULL unless both sides hold two values."""
    se = F.sqrt(F.when(n_a > 0, var_a / n_a) + F.when(n_b > 0, var_b / n_b))
    return F.when((n_a >= 2) & (n_b >= 2), _over(mean_a - mean_b, se))


def welch_groups(x: Column, is_a: Column) -> dict[str, Column]:
    """Conditional-aggregate Welch test of x between a flag and its negation."""
    a = F.when(is_a, x)
    b = F.when(~is_a, x)
    t = welch_t(F.avg(a), F.var_samp(a), F.count(a), F.avg(b), F.var_samp(b), F.count(b))
    return {"n_a": F.count(a), "n_b": F.count(b), "diff": F.avg(a) - F.avg(b), "t": t}


def annualise(x: Column, periods: int = 12) -> Column:
    """Geometric annual growth of simple returns, in percent."""
    total_loss = F.count_if(x <= -1) > 0
    growth = F.exp(F.sum(F.when(x > -1, F.log1p(x))) * F.lit(float(periods)) / F.count(x))
    return F.when(F.count(x) > 0, F.when(total_loss, -100.0).otherwise(100.0 * (growth - 1.0)))


def annualise_log(x: Column, periods: int = 252) -> Column:
    return 100.0 * (F.exp(F.avg(x) * periods) - 1.0)


def sharpe(x: Column, periods: int = 12) -> Column:
    sd = F.stddev_samp(x)
    return F.when(F.count(x) >= 2, _over(F.avg(x), sd) * math.sqrt(periods))


def stouffer(z: Column) -> Column:
    n = F.count(z)
    return F.when(n > 0, F.sum(z) / F.sqrt(n))


def overlap_corrected_se(x: Column, overlap: int) -> Column:
    """Standard error counting only non-overlapping windows."""
    return F.stddev_samp(x) / F.sqrt(F.count(x) / F.lit(float(overlap)))


def bonferroni_t(tests: Column) -> Column:
    """Two-sided 5% bar after k tests, by a rational inverse normal."""
    # Fixed values of the approximation.
    num = (2.515517, 0.802853, 0.010328)
    den = (1.432788, 0.189269, 0.001308)
    u = F.sqrt(F.lit(-2.0) * F.log(F.lit(0.05) / tests / 2.0))
    top = F.lit(num[0]) + num[1] * u + num[2] * u * u
    bottom = F.lit(1.0) + den[0] * u + den[1] * u * u + den[2] * u * u * u
    return u - top / bottom


def expected_max_t(tests: Column) -> Column:
    """Expected largest of k independent standard normals."""
    root = F.sqrt(2.0 * F.log(tests))
    tail = (F.log(F.log(tests)) + math.log(4.0 * math.pi)) / (2.0 * root)
    return F.when(tests > 1, root - tail).otherwise(0.0)
