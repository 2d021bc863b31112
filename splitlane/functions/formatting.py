"""Rounding and labels for readout columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column, places: int) -> Column:
    """Rounded half away from zero, however the last bits of ``value`` fell.

    Sums of doubles may differ in their last bits between runs and engines, which would
    decide ties. A thousandth of the last place shown, whatever the value's size, settles
    them and cannot move any other result.
    """
    return F.round(value + F.signum(value) * F.lit(10.0 ** -(places + 3)), places)


def pretty_round(value: Column, places: int | None = None) -> Column:
    """Fewer decimals the larger the value, unless ``places`` fixes them."""
    if places is not None:
        return settled(value, places)
    size = F.abs(value)
    return (
        F.when(size >= 100, settled(value, 1))
        .when(size >= 1, settled(value, 2))
        .when(size >= 0.01, settled(value, 3))
        .otherwise(settled(value, 4))
    )


def _label(pattern: str, value: Column) -> Column:
    # format_string would print a missing value as the text "null".
    return F.when(value.isNotNull(), F.format_string(pattern, value))


def signed_pp(value: Column) -> Column:
    """A fraction as signed percentage points, such as ``+0.89pp``."""
    return _label("%+.2fpp", settled(value * 100.0, 2))


def percent(value: Column, places: int = 1) -> Column:
    """A fraction as a percentage, such as ``91.8%``."""
    return _label(f"%.{places}f%%", settled(value * 100.0, places))


def money(value: Column) -> Column:
    return _label("$%.2f", settled(value, 2))
