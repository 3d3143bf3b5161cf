"""Column expressions for quantiles and counts that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def quantile8(c: Column, p: float) -> Column:
    """Type-8 quantile of the finite values of a group: h = 1/3 + p (n + 1/3),
    interpolated between order statistics, clamped to the range; null for none.

    The group's values are collected, so it is meant for summaries of fits (bounded
    by the model budget), not for samples; ``quantile8_grouped`` has no such bound.
    """
    x = F.array_sort(F.collect_list(finite(c)))
    n = F.size(x)
    h = F.lit(1.0 / 3) + F.lit(p) * (n + F.lit(1.0 / 3))
    low = F.floor(h).cast("int")
    at = lambda i: F.get(x, F.greatest(F.lit(1), F.least(n, i)) - 1)
    return F.when(n > 0, at(low) + (h - low) * (at(low + 1) - at(low)))


def choose2(c: Column) -> Column:
    d = c.cast("double")
    return d * (d - 1) / 2


def quantile8_values(values: list[float], p: float) -> float | None:
    """The same on a Python list."""
    x = sorted(v for v in values if v is not None and math.isfinite(v))
    if not x:
        return None
    h = 1 / 3 + p * (len(x) + 1 / 3)
    low = math.floor(h)
    at = lambda i: x[min(max(i, 1), len(x)) - 1]
    return at(low) + (h - low) * (at(low + 1) - at(low))
