"""Masking expressions for sensitive values (JVM-side, no Python per row).

Each function maps a column to its masked string; NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import number_from_text


def _null_str() -> Column:
    return F.lit(None).cast("string")


def mask_email(c: Column) -> Column:
    """``john.doe@example.com`` -> ``j***@example.com``.

    First character of the local part, ``***@``, then everything after the
    first ``@``. A value without ``@`` is returned unchanged; an empty local
    part gives ``***@domain`` (the ``@`` itself is never shown as the first
    character).
    """
    s = c.cast("string")
    parts = F.split(s, "@", 2)
    masked = F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.lit("***@"),
                      F.element_at(parts, 2))
    return F.when(s.isNull(), _null_str()).when(F.instr(s, "@") > 0, masked).otherwise(s)


def mask_id(c: Column) -> Column:
    """Length <= 4 -> ``****``; else first 2 chars, one star per hidden char,
    last 2 chars. Used for id and phone columns."""
    s = c.cast("string")
    n = F.length(s)
    masked = F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 4),
                      F.substring(s, -2, 2))
    return F.when(s.isNull(), _null_str()).when(n <= 4, F.lit("****")).otherwise(masked)


def to_double(c: Column, dt: T.DataType | None = None) -> Column:
    """Numbers as double; text parsed leniently (surrounding blanks allowed),
    anything unparsable as NULL."""
    if dt is not None and isinstance(dt, (T.NumericType, T.BooleanType)):
        return c.cast("int").cast("double") if isinstance(dt, T.BooleanType) else c.cast("double")
    return number_from_text(c)


def mask_financial(c: Column, dt: T.DataType | None = None) -> Column:
    """Last three digits of the comma-grouped whole amount, sign kept.

    ``2095.23`` -> ``***095``; ``-1234567.891`` -> ``-***568``; amounts of
    three digits or fewer -> ``***``; text that is not a number -> ``***``.
    Rounding to the whole number is half-even on the binary value.
    """
    v = to_double(c, dt)
    grouped = F.format_number(F.abs(v), 0)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    tail = F.when(F.length(grouped) > 3, F.substring(grouped, -3, 3)).otherwise(F.lit(""))
    return F.when(c.isNull(), _null_str()) \
        .when(v.isNull() | F.isnan(v), F.lit("***")) \
        .when(F.abs(v) == F.lit(float("inf")), F.concat(sign, F.lit("***"))) \
        .otherwise(F.concat(sign, F.lit("***"), tail))
