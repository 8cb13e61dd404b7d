"""Money: DOUBLE per row, whole units of 1e-8 dollars while summing, DOUBLE in reports."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

UNITS_PER_DOLLAR = 100_000_000
RUNNING = "decimal(28,8)"


def units(col: Column) -> Column:
    """A dollar amount of eight decimals as a whole number of units."""
    return F.rint(col * UNITS_PER_DOLLAR).cast("long")


def from_units(total: Column) -> Column:
    """Exact dollars of a unit count, zero for none."""
    amount = (total.cast("decimal(19,0)") * F.lit(Decimal("0.00000001"))).cast(RUNNING)
    return F.coalesce(amount, F.lit(0).cast(RUNNING))


def exact_sum(col: Column) -> Column:
    """Order-independent sum, zero over no rows.

    Whole numbers add exactly and fast; a total beyond 92 billion dollars fails instead of wrapping.
    """
    return from_units(F.sum(units(col)))


def dollars(col: Column) -> Column:
    return F.round(col.cast("double"), 8)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, zero where the whole is zero or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(ratio(part, whole) * 100, digits)
