"""Casts, sums and roundings whose results do not depend on row order or ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,8)"  # amounts below 1e30, to 1e-8
TOTAL = MONEY
LARGEST_AMOUNT = 1e20  # and beyond: unreadable in files, rejected in events; ten billion smaller ones add up


def double_of(text: Column) -> Column:
    return text.try_cast("double")


def amount_of(number: Column) -> Column:
    """``number``, or NULL where it is no number, infinite or as large as ``LARGEST_AMOUNT``."""
    return F.when(F.abs(number) < LARGEST_AMOUNT, number)


def money_total(amount: Column) -> Column:
    """Sum of money in decimals.

    Adding doubles gives other last bits for another row order, so a retried task or another
    partitioning would change scores. Decimal sums are the same in any order, and sums of parts add up.
    Eight digits are kept of each amount; a total of 1e30 and more is an error, never a wrong number.
    """
    return F.sum(amount.cast(MONEY)).cast(TOTAL)


def exact_sum(amount: Column) -> Column:
    return money_total(amount).cast("double")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is NULL or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def rounded_units(value: Column, digits: int, ties: str = "even") -> Column:
    """``abs(value)`` in units of 10^-digits, correctly rounded from the binary value.

    The value is split into two halves of its bits, so that both products with 10^digits are exact and
    the distance to the next half unit has the right sign. ``ties`` is ``even`` (Python, C) or ``up``
    (JavaScript ``toFixed``); ``digits`` is at most 4. Pass a plain column: the expression repeats it.
    """
    scale = float(10**digits)
    size = F.abs(value.cast("double"))
    spread = size * float(2**27 + 1)
    high = spread - (spread - size)
    low = size - high
    product, rest = high * scale, low * scale  # both exact
    units = F.floor(product + rest)
    over_half = (product - units.cast("double") - 0.5) + rest
    tied = over_half == 0
    goes_up = (over_half > 0) | (tied & (units % 2 == 1) if ties == "even" else tied)
    return units + goes_up.cast("long")


def rounded(value: Column, digits: int, ties: str = "even") -> Column:
    """``value`` to ``digits`` places as double, rounded from its exact binary value."""
    size = rounded_units(value, digits, ties).cast("double") / F.lit(float(10**digits))
    return F.when(value < 0, -size).otherwise(size)


def fixed_text(value: Column, digits: int, ties: str = "even") -> Column:
    """``%.{digits}f`` text, rounded from the exact binary value."""
    units = rounded_units(value, digits, ties)
    if digits == 0:
        body = units.cast("string")
    else:
        scale = F.lit(10**digits).cast("long")
        body = F.concat(
            F.floor(units / scale).cast("string"),
            F.lit("."),
            F.lpad((units % scale).cast("string"), digits, "0"),
        )
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), body)
