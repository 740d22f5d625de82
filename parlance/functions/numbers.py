"""Numeric column helpers shared by the reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding on the double itself, stable across engines."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / F.lit(scale)


def fixed_text(value: Column, digits: int = 2) -> Column:
    """A number as text with a fixed number of decimals, from half-up rounded integer parts."""
    scale = 10**digits
    units = F.floor(F.abs(value) * float(scale) + 0.5).cast("long")
    sign = F.when((value < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    whole = (units - F.pmod(units, F.lit(scale))) / F.lit(scale)
    return F.concat(
        sign, whole.cast("long").cast("string"), F.lit("."), F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")
    )


def skip_null_mean(*values: Column) -> Column:
    """Row-wise mean of the values that are present; null when none is."""
    present = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(present > 0, total / present)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, 0 when the denominator is 0 or missing."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def student_t_two_sided(t: Column, degrees: int) -> Column:
    """Two-sided p-value of Student's t for a whole number of degrees of freedom.

    The cumulative distribution has a finite trigonometric series in
    ``theta = atan(t / sqrt(degrees))`` (Abramowitz & Stegun 26.7.3 and 26.7.4).
    """
    if degrees < 1:
        raise ValueError("degrees of freedom must be at least 1")
    theta = F.atan(F.abs(t) / F.lit(math.sqrt(degrees)))
    cos, sin = F.cos(theta), F.sin(theta)
    if degrees % 2:
        series, term = F.lit(0.0), cos
        for step in range(1, degrees, 2):
            if step > 1:
                term = term * cos * cos * F.lit((step - 1) / step)
            series = series + term
        inside = F.lit(2 / math.pi) * (theta + sin * series)
    else:
        series, term = F.lit(1.0), F.lit(1.0)
        for step in range(2, degrees, 2):
            term = term * cos * cos * F.lit((step - 1) / step)
            series = series + term
        inside = sin * series
    return F.lit(1.0) - inside
