"""Aggregates that give null, not an error, on constant input.

``corr`` divides by zero under ANSI mode when a column is constant, so these are
built from covariance and deviation. All of them combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from innsight.functions.pricing import _col


def _paired(x, y) -> tuple[Column, Column]:
    """Both columns, with null where either is null."""
    x, y = _col(x), _col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def safe_corr(x, y) -> Column:
    """Pearson correlation; null for fewer than two pairs or a constant side."""
    x, y = _paired(x, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_slope(x, y) -> Column:
    """Least-squares slope of y over x; null when x is constant."""
    x, y = _paired(x, y)
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))


def pair_count(x, y) -> Column:
    return F.count_if(_col(x).isNotNull() & _col(y).isNotNull())


def confidence(mean, deviation, n) -> Column:
    """1 minus the relative standard error of a mean, kept within 0..1."""
    relative = F.try_divide(_col(deviation), F.sqrt(_col(n)) * _col(mean))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - relative))
    return F.when(relative.isNotNull(), bounded)
