"""Date helpers: period labels for trends and the datetime-text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, qcol

# Period codes accepted by the trend operator; anything else becomes "M".
FREQS = ("D", "W", "M", "Q", "Y")

# Candidate formats tried on text columns, best single format wins. ``None``
# is Spark's own ISO-8601 parsing (date, date time, 'T', fractions, zone).
DATETIME_FORMATS: tuple[str | None, ...] = (
    None,
    "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "M/d/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)


# What a text must look like to be read under a part of a format. Years may have a sign and more digits;
# numbers of one letter may have leading zeros. Each is as wide as Spark's parser or wider.
_SHAPES = {
    "yyyy": "[+-]?[0-9]{4,}", "M": "0*([1-9]|1[0-2])", "MM": "(0[1-9]|1[0-2])", "MMM": "[^0-9 ]{3,4}", "MMMM": "[^0-9 ]{3,9}",
    "d": "0*([1-9]|[12][0-9]|3[01])", "dd": "(0[1-9]|[12][0-9]|3[01])", "HH": "([01][0-9]|2[0-3])", "mm": "[0-5][0-9]",
    "ss": "[0-5][0-9]"}
# no number has over 19 digits, so no text of such a format has more bytes
_LONGEST = 100


def _shape(fmt: str) -> str | None:
    """Pattern of all texts that the format can read; None if a part of it is not known."""
    parts = [m.group() for m in re.finditer(r"([A-Za-z])\1*|[^A-Za-z]", fmt)]
    if any(p not in _SHAPES and p not in "/-.:, " for p in parts):
        return None
    return f"^{''.join(_SHAPES.get(p) or re.escape(p) for p in parts)}$"


def parse_datetime(c: Column, fmt: str | None = None) -> Column:
    """Text to timestamp_ntz; unparsable text gives NULL (never an error).

    Spark's parser answers a text of another format with an exception, many times dearer than a parse;
    so it gets only texts of the format's shape (that of Spark's own parser, not of its legacy one).
    """
    if fmt is None:
        return c.cast("string").try_cast("timestamp_ntz")
    parsed, shape = F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"), _shape(fmt)
    if shape is None:
        return parsed
    return F.when((F.octet_length(c.cast("string")) <= _LONGEST) & c.cast("string").rlike(shape), parsed)


def best_format(c: Column) -> Column:
    """Aggregate: number of the format in ``DATETIME_FORMATS`` that parses most texts (first on ties)."""
    parsed = [F.struct(F.count(parse_datetime(c, f)).alias("n"), F.lit(-i).alias("i"))
              for i, f in enumerate(DATETIME_FORMATS)]
    return -F.greatest(*parsed).getField("i")


def parse_by_number(c: Column, number: Column) -> Column:
    """Text to timestamp_ntz by the format of that number."""
    chosen = F.lit(None).cast("timestamp_ntz")
    for i, f in enumerate(DATETIME_FORMATS):
        chosen = F.when(number == i, parse_datetime(c, f)).otherwise(chosen)
    return chosen


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A column as timestamp_ntz: timestamps and dates directly, text parsed."""
    dt = field(df, name).dataType
    c = qcol(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        return parse_datetime(c)
    return F.lit(None).cast("timestamp_ntz")


def period_label(ts: Column, freq: str) -> Column:
    """Label of the period that holds ``ts``.

    D: the day itself; W: the Sunday that ends the Monday-Sunday week;
    M, Q, Y: last day of the month, quarter, year (all at midnight).
    """
    freq = freq if freq in FREQS else "M"
    if freq == "D":
        lab = F.date_trunc("DAY", ts)
    elif freq == "W":
        lab = F.date_add(F.to_date(F.date_trunc("WEEK", ts)), 6)
    elif freq == "M":
        lab = F.last_day(ts)
    elif freq == "Q":
        lab = F.last_day(F.add_months(F.to_date(F.date_trunc("QUARTER", ts)), 2))
    else:
        lab = F.make_date(F.year(ts), F.lit(12), F.lit(31))
    return lab.cast("timestamp_ntz")
