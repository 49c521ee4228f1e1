"""Decimal rules: where values are rounded, truncated or divided."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.schemas import MONEY, NAV, RATIO, SHARES

WHOLE = float(2**53)  # below it, doubles hold every whole number


def money(amount: Column) -> Column:
    """Round half away from zero to cents."""
    return F.round(amount, 2).cast(MONEY)


def price(amount: Column) -> Column:
    """Round a net asset value to its four decimals."""
    return F.round(amount, 4).cast(NAV)


def trunc5(shares: Column) -> Column:
    """Cut shares down to five decimals; exact, since the input is a decimal."""
    return F.floor(shares, F.lit(5)).cast(SHARES)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with twelve decimals; NULL on a zero whole."""
    return F.try_divide(part, whole).cast(RATIO)


def shares_for(amount: Column, nav: Column) -> Column:
    """Whole five-decimal shares that ``amount`` buys at ``nav``."""
    return trunc5(F.try_divide(amount, nav))


def value_of(shares: Column, nav: Column) -> Column:
    """Unrounded worth of a number of shares."""
    return shares * nav


def growth(value: Column, base: Column, digits: int = 4) -> Column:
    """Relative change ``value / base - 1``, rounded; NULL on a zero base."""
    return F.round(F.try_divide(value.cast("double"), base.cast("double")) - 1, digits)


def units(amount: Column, kind: T.DecimalType) -> Column:
    """A decimal of ``kind`` as the number of its last digits, as a double."""
    return (amount * F.lit(10**kind.scale).cast(T.DecimalType(kind.scale + 1))).cast("double")


def exact_product(a: Column, b: Column, scale: int, otherwise: Column) -> Column:
    """Product of two ``units`` whose decimals have ``scale`` digits in all, as the double next to it.

    Where it might not be, as it or a factor is too large, ``otherwise``.
    """
    product = a * b
    # A zero has no sign.
    return F.when(F.abs(product) < WHOLE, product / F.lit(float(10**scale)) + F.lit(0.0)).otherwise(otherwise)
