"""Readings of a number as a word: bands, targets, markers."""

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(_col(num).cast("double"), _col(den)), F.lit(0.0))


def f1(precision, recall) -> Column:
    p, r = _col(precision), _col(recall)
    return ratio(2 * p * r, p + r)


def landis_koch(value) -> Column:
    v = _col(value)
    return (
        F.when(v < 0, "Poor")
        .when(v < 0.20, "Slight")
        .when(v < 0.40, "Fair")
        .when(v < 0.60, "Moderate")
        .when(v < 0.80, "Substantial")
        .when(v.isNotNull(), "Almost Perfect")
    )


def gap_status(gap) -> Column:
    g = _col(gap)
    return F.when(g < 0.05, "Robust").when(g < 0.15, "Mild gap").otherwise("Large gap")


def significance_stars(p) -> Column:
    p = _col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def rate_marker(rate, kind) -> Column:
    """good, warn or bad for a rate in percent; kind is FP (low is good) or TP."""
    r, k = _col(rate), _col(kind)
    fp = F.when(r > 30, "bad").when(r > 10, "warn").otherwise("good")
    tp = F.when(r > 80, "good").when(r > 50, "warn").otherwise("bad")
    return F.when(k == "FP", fp).otherwise(tp)


def meets_target(value, target: float) -> Column:
    return _col(value) >= F.lit(target)
