"""Rounding as Python does it: to the decimal nearest to the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1 cuts a double into two halves whose products are exact


def py_round(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of Python for a non-negative or negative double.

    ``F.round`` decides half-way cases on the shortest decimal text of a double (0.00015 goes up), this
    on its exact value (0.00015 is stored below the middle and goes down).
    """
    x = x.cast("double")
    scale = F.lit(float(10**digits))
    a = F.abs(x)
    high = F.lit(_SPLITTER) * a - (F.lit(_SPLITTER) * a - a)
    product = a * scale
    error = (high * scale - product) + (a - high) * scale
    whole = F.floor(product).cast("double")
    over = (product - whole - 0.5) + error
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    return F.signum(x) * (whole + F.when(up, 1.0).otherwise(0.0)) / scale
