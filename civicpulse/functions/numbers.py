"""Numeric column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mean_of(value: Column) -> Column:
    """Average as a double; decimals are summed exactly first, so order cannot change it."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def round_to(value: Column, places: int) -> Column:
    """Round ties to the even digit after scaling, as numpy does (0.25 -> 0.2, 0.35 -> 0.4)."""
    scale = float(10**places)
    return F.rint(value.cast("double") * F.lit(scale)) / F.lit(scale)


def round_one(value: Column) -> Column:
    """Round to one place as Python does: by the exact binary value (0.35 -> 0.3, 0.25 -> 0.2)."""
    number = value.cast("double")
    # Ten times the number is eight times plus twice, both exact; ``error`` is what their sum lost.
    eight, two = number * 8.0, number * 2.0
    scaled = eight + two
    part = scaled - eight
    error = (eight - (scaled - part)) + (two - part)
    halfway = F.abs(scaled - F.rint(scaled)) == 0.5
    whole = F.when(halfway & (error > 0), scaled + 0.5).when(halfway & (error < 0), scaled - 0.5)
    return whole.otherwise(F.rint(scaled)) / 10.0


def nan_to_null(value: Column) -> Column:
    """Turn floating NaN into NULL, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def to_number(text: Column) -> Column:
    """Lenient text to double: NULL for anything but a plain number."""
    # Java also reads "1d", "2f" and "NaN" as numbers; here such a cell counts as missing.
    plain = F.when(~text.rlike(r"(?i)([0-9.][df]|nan)\s*$"), text)
    return plain.try_cast("double")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def sortable(value: Column, kind: T.DataType) -> Column:
    """A whole number of 64 bits that orders like ``value``; equal only for equal values, NULL for NULL.

    Floating numbers give their exponent and fraction, as their binary form has them: 0.0 and -0.0 are
    equal, NaN is the largest. Decimals above 18 digits are taken as floating numbers.
    """
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(Decimal(10**kind.scale))).cast("long")
    number = value.cast("double")
    size = F.abs(number)
    guess = F.floor(F.log2(size)).cast("double")
    # The logarithm may be off by one next to a power of two.
    guess = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    exponent = F.greatest(guess, F.lit(-1022.0))
    fraction = size / F.pow(F.lit(2.0), exponent)
    step = float(2**52)
    bits = (exponent + 1023).cast("long") * F.lit(2**52) + ((fraction - 1) * step).cast("long")
    endless = F.lit(2047 * 2**52)
    bits = (
        F.when(F.isnan(number), endless + 1).when(size == F.lit(float("inf")), endless)
        .when(size == 0, F.lit(0)).when(number.isNotNull(), bits)
    )
    return F.when(number < 0, -bits).otherwise(bits)


def packed(high: Column, low: Column, low_bits: int) -> Column:
    """Two whole numbers as one that orders by ``high``, then by ``low``, which is 0 or more and below 2^low_bits.

    Such a number has a fixed width, so a hash aggregate can take its maximum, as it can't of a struct.
    """
    return high.cast("decimal(20,0)") * F.lit(Decimal(2**low_bits)) + low.cast("decimal(20,0)")
