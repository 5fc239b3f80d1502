"""Rounding and ratios as the outputs define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_SALARY, HIGH_SALARY = 20_000, 300_000


def rint(c: Column, places: int = 4) -> Column:
    """Half to even on the scaled number, as numpy rounds; not `round` (half up) nor `bround`."""
    k = float(10**places)
    return F.rint(c * F.lit(k)) / F.lit(k)


def share(part: Column, whole: Column) -> Column:
    """part / whole in 4 decimals; null for an empty whole."""
    return rint(F.try_divide(part.cast("double"), whole.cast("double")))


def annual(low: Column, high: Column, currency: Column, unit: Column) -> Column:
    """Middle of a salary range a year: a missing end is the other one, months count twelve times. Null unless it
    is in CHF by year or month and within 20,000 to 300,000."""
    low, high = low.try_cast("double"), high.try_cast("double")
    middle = (F.coalesce(low, high) + F.coalesce(high, low)) / F.lit(2.0)
    yearly = F.when(F.upper(unit) == "MONTH", middle * 12).when(F.upper(unit) == "YEAR", middle)
    return F.when((F.upper(currency) == "CHF") & yearly.between(LOW_SALARY, HIGH_SALARY), yearly)
