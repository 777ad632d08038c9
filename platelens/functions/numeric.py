"""Numeric coercion of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number: optional sign, digits with optional fraction (or a
# bare fraction), optional exponent, surrounding whitespace allowed. Spark's
# own cast would also accept suffixes such as '1d' or '1f', and 'Infinity';
# those are not numbers here.
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_number_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(_NUMBER)


def coerce_numeric(c) -> Column:
    """Text -> finite double, else null (never raises under ANSI mode).

    Text that is no number is null, and so is a number beyond the range of a
    double (``1e400``). Doubles pass through, NaN and +-inf made null.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(is_number_text(c.cast("string")),
                  finite_or_null(F.trim(c.cast("string")).try_cast("double")))


def finite_or_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
