"""Return measures and the documented tax brackets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper gain limits and rates of the savings tax brackets.
TAX_LOW_LIMIT = 6000
TAX_HIGH_LIMIT = 50000
TAX_RATES = ("0.19", "0.21", "0.23")


def annualised(gain: Column, capital: Column, days: Column) -> Column:
    """Yearly return in percent: zero gain gives 0, unknown or zero days NULL."""
    base = 1 + F.try_divide(gain.cast("double"), capital.cast("double"))
    yearly = (F.pow(base, F.lit(365.0) / days) - 1) * 100
    return F.when(gain == 0, F.lit(0.0)).when(days.isNull() | (days == 0), None).otherwise(yearly)


def percent_change(value: Column, previous: Column) -> Column:
    """Change in percent with the two decimals shown in reports."""
    return F.round((F.try_divide(value.cast("double"), previous.cast("double")) - 1) * 100, 2)


def trend_sign(value: Column, previous: Column) -> Column:
    """'-' when the value fell at five decimals, else '+'."""
    relation = F.round(F.try_divide(value.cast("double"), previous.cast("double")), 5)
    return F.when(relation < 1, F.lit("-")).otherwise(F.lit("+"))


def tax_rate(gain: Column) -> Column:
    """Rate of the bracket that a yearly gain falls in."""
    low, middle, high = (F.lit(rate).cast("decimal(3,2)") for rate in TAX_RATES)
    return (
        F.when(gain < TAX_LOW_LIMIT, low).when(gain <= TAX_HIGH_LIMIT, middle).otherwise(high)
    )


def series_label(terminal_lot: Column, order_id: Column) -> Column:
    """Name of one return series."""
    return F.concat_ws("/", terminal_lot, order_id)
