"""Deterministic hash assignment and hash-based uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SALT = "experiment_v1"
HEX_DIGITS = 8
DRAW_RANGE = 16**HEX_DIGITS


def _text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def salted_digest(unit: Column | str, salt: Column | str) -> Column:
    """md5 of ``unit:salt``; ``salt`` may be a literal string or a column."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat(_text(unit), F.lit(":"), salt))


def variant_of_digest(digest: Column) -> Column:
    """The digest read as a number: even is treatment, odd is control."""
    even = F.substring(digest, 32, 1).isin(*"02468ace")
    return F.when(even, "treatment").otherwise("control")


def assign_variant(user_id: Column | str, salt: str = DEFAULT_SALT) -> Column:
    return variant_of_digest(salted_digest(user_id, salt))


def draw(digest: Column, slot: int) -> Column:
    """Eight hex digits of a digest: slot 0, 1 or 2 give independent draws.

    Draws of equal length compare as text exactly as they compare as numbers, so a
    test against :func:`draw_threshold` needs no base conversion per row.
    """
    return F.substring(digest, 1 + HEX_DIGITS * slot, HEX_DIGITS)


def draw_threshold(probability: Column | float) -> Column:
    """``draw(..) < draw_threshold(p)`` holds with probability p, for p below 1."""
    p = F.lit(probability) if not isinstance(probability, Column) else probability
    cut = F.floor(F.least(p, F.lit(1.0)) * F.lit(float(DRAW_RANGE)))
    # "g" sorts after every hex digit: p of 1 or more accepts every draw.
    return F.when(cut >= DRAW_RANGE, F.lit("g")).otherwise(
        F.lpad(F.lower(F.hex(cut.cast("bigint"))), HEX_DIGITS, "0")
    )
