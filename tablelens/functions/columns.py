"""Column classes and null rules shared by every operator.

Null contract (applied on entry to every statistic):
- NaN in a float/double column counts as missing, so it is turned into NULL
  before any aggregate sees it (Spark's avg/max/count would otherwise keep it);
- -0.0 is folded into 0.0 so distinct counts agree with value equality;
- statistics are computed in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_CLASS = "numeric"
DATETIME_CLASS = "datetime"
DATETIME_LIKE_CLASS = "datetime_like"
CATEGORICAL_CLASS = "categorical"
OTHER_CLASS = "other"


def field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(name)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_numeric(dt: T.DataType, include_bool: bool = False) -> bool:
    if isinstance(dt, T.NumericType):
        return True
    return include_bool and isinstance(dt, T.BooleanType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Numeric columns in schema order (booleans only when asked: the profile
    counts them as numeric, the analysis operations do not)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType, include_bool)]


def qcol(name: str) -> Column:
    """Column by exact name, safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL and -0.0 as 0.0 (floats only)."""
    c = qcol(name)
    dt = field(df, name).dataType
    if is_float(dt):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c + F.lit(0.0).cast(dt))
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column in double precision (booleans as 0/1)."""
    dt = field(df, name).dataType
    c = clean_value(df, name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = qcol(name)
    if is_float(field(df, name).dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over pairwise-complete rows; NULL when either side is
    constant (Spark's ``corr`` divides by zero under ANSI mode)."""
    den = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), F.nullif(den, F.lit(0.0)))


# text that is a number: Java's parser would also take suffixes (12D, 3f) and hexadecimal
NUMBER_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
WHOLE_TEXT = r"^[+-]?\d+$"


def number_from_text(c: Column) -> Column:
    """Text as double, blanks around it allowed; NULL if it isn't written as a number."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()
