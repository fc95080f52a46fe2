"""Cleaning actions (C0-C6) and ordered cleaning plans.

A plan is read once into its fills and the columns whose gaps drop rows. The rows that a
fill's statistic sees are those that earlier drops left, and a drop's condition looks at
one column of the row alone; so every statistic is a conditional aggregate over the input
table, whatever its place in the plan: all means share one aggregation, all modes one
frequency table, all medians the scans of :mod:`quantiles`. The number of scans doesn't grow with
the steps. The statistics are one row, joined back by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, clean_value, field, is_missing, is_numeric, qcol
from .analysis import missing_values
from .quantiles import column_quantiles

ACTIONS = ("drop", "drop_column", "impute_mean", "impute_median", "impute_mode")


def missing_columns(df: DataFrame) -> DataFrame:
    """Columns that need cleaning: ``(column_name, missing, type)`` for every
    column with at least one missing value."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema.fields],
        "column_name string, type string")
    return missing_values(df).where(F.col("missing") > 0) \
        .join(F.broadcast(types), "column_name", "left")


def drop_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value in ``column`` is missing (NULL or NaN) are removed."""
    return df.where(~is_missing(df, column))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


@dataclass(frozen=True)
class Fill:
    """One fill of a plan: of ``column``, by ``action``, as step ``number`` of the fills.

    ``passed``: columns whose gaps dropped rows before. ``needs``: earlier fills of columns whose gaps dropped
    rows after the fill; such a drop takes all rows if there was nothing to fill with, and none otherwise.
    """

    number: int
    column: str
    action: str
    passed: tuple[str, ...] = ()
    needs: tuple[int, ...] = ()

    @property
    def name(self) -> str:
        return f"_s{self.number}"

    def seen(self, df: DataFrame, value: Column) -> Column:
        """``value`` in the rows that the statistic covers, NULL in all others."""
        for c in self.passed:
            value = F.when(~is_missing(df, c), value)
        return value


def _as_text(value: Column, dt: T.DataType) -> Column:
    """A value as text from which ``_from_text`` makes the same value again."""
    return (F.unix_micros(value) if isinstance(dt, T.TimestampType) else value).cast("string")


def _from_text(text: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast(dt)


def _modes(df: DataFrame, fills: list[Fill]) -> DataFrame:
    """One row: each fill's most frequent value, smallest on ties; NULL if there is none."""
    types = {f.number: field(df, f.column).dataType for f in fills}
    plain = [f for f in fills if isinstance(types[f.number], T.AtomicType) and not isinstance(types[f.number], T.BinaryType)]
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    if plain:
        long = df.select(F.inline(F.array(*[F.struct(
            F.lit(f.number).alias("_k"),
            _as_text(f.seen(df, clean_value(df, f.column)), types[f.number]).alias("_v")) for f in plain])))
        freq = long.where(F.col("_v").isNotNull()).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
        best = freq.agg(*[F.min(F.when(F.col("_k") == f.number, F.struct(
            -F.col("_n"), _from_text(F.when(F.col("_k") == f.number, F.col("_v")), types[f.number]).alias("v")))).alias(f.name)
            for f in plain]).select(*[F.col(f.name)["v"].alias(f.name) for f in plain])
        one = one.crossJoin(best)
    for f in fills:
        if f not in plain:
            v = df.select(f.seen(df, clean_value(df, f.column)).alias(f.name)).where(F.col(f.name).isNotNull())
            top = v.groupBy(f.name).count().orderBy(F.col("count").desc(), F.col(f.name).asc()).limit(1).select(
                f.name, F.lit(1).alias("_two"))
            one = one.join(top, F.col("_one") == F.col("_two"), "left").drop("_two")
    return one.drop("_one")


def _statistics(df: DataFrame, fills: list[Fill], method: str) -> DataFrame:
    """One row with each fill's value: NULL if it has none, or if a drop before it left no rows."""
    parts = []
    by = {a: [f for f in fills if f.action == a] for a in ("impute_mean", "impute_median", "impute_mode")}
    if means := by["impute_mean"]:
        parts.append(df.agg(*[F.avg(f.seen(df, as_double(df, f.column))).alias(f.name) for f in means]))
    if medians := by["impute_median"]:
        values = df.select(*[f.seen(df, as_double(df, f.column)).alias(f.name) for f in medians])
        q = column_quantiles(values, [f.name for f in medians], [0.5], method)
        parts.append(q.agg(*[F.max(F.when(F.col("_k") == k, F.col("q")[0])).alias(f.name)
                             for k, f in enumerate(medians)]))
    if modes := by["impute_mode"]:
        parts.append(_modes(df, modes))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.crossJoin(p)
    for f in fills:  # in order, so that what an earlier fill lacks passes on
        for n in f.needs:
            stats = stats.withColumn(f.name, F.when(F.col(f"_s{n}").isNotNull(), F.col(f.name)))
    return stats


def _cleaned(df: DataFrame, fills: list[Fill], passed: list[str], needs: list[int], columns: list[str],
             method: str) -> DataFrame:
    """``columns`` of the rows without gaps in ``passed``, filled; no rows if a needed fill has no value."""
    rows = df
    for c in passed:
        rows = rows.where(~is_missing(df, c))
    if not fills:
        return rows.select(*[qcol(c) for c in columns])
    filled = {f.column: f for f in fills}
    j = rows.crossJoin(F.broadcast(_statistics(df, fills, method)))  # one row by construction
    for n in needs:
        j = j.where(F.col(f"_s{n}").isNotNull())
    out = []
    for c in columns:
        if c in filled:
            dt = field(df, c).dataType if filled[c].action == "impute_mode" else T.DoubleType()
            out.append(F.coalesce(clean_value(df, c).cast(dt), F.col(filled[c].name).cast(dt)).alias(c))
        else:
            out.append(qcol(c))
    return j.select(*out)


def impute(df: DataFrame, columns_actions: list[tuple[str, str]], method: str = "exact") -> DataFrame:
    """Fill missing values of several columns at once.

    ``columns_actions`` holds ``(column, action)`` with action in impute_mean,
    impute_median, impute_mode; all statistics are computed on the input rows. Mean/median on a
    non-numeric column is a no-op; mean/median results are double.
    """
    return apply_cleaning_plan(df, [{"column": c, "action": a} for c, a in columns_actions if a in ACTIONS[2:]], method)


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    return impute(df, [(column, "impute_mean")])


def impute_median(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    return impute(df, [(column, "impute_median")], method)


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    return impute(df, [(column, "impute_mode")])


def validate_cleaning_plan(steps, columns) -> list[dict]:
    """Keep steps whose action is allowed and whose column exists."""
    if not isinstance(steps, list):
        return []
    cols = set(columns)
    return [s for s in steps if isinstance(s, dict) and s.get("action") in ACTIONS
            and s.get("column") in cols]


def _fills(df: DataFrame, column: str, action: str) -> bool:
    """Mean and median of a column that isn't numeric are no-ops."""
    dt = field(df, column).dataType
    return action == "impute_mode" or (is_numeric(dt, include_bool=True) and not isinstance(dt, T.BooleanType))


def apply_cleaning_plan(df: DataFrame, steps, method: str = "exact") -> DataFrame:
    """Apply cleaning steps in order; a step on a column that doesn't exist (any more) is skipped.

    Statistics see the rows that earlier drops left. A filled column has no gaps, unless there was
    nothing to fill with: then a later drop takes all rows. A second fill of a column finds nothing to do.
    """
    fills: dict[str, Fill] = {}
    passed: list[str] = []
    needs: list[int] = []
    columns = list(df.columns)
    for step in steps or []:
        if not isinstance(step, dict):
            continue
        action, col = step.get("action"), step.get("column")
        if action not in ACTIONS or col not in columns:
            continue
        if action == "drop_column":
            columns.remove(col)
        elif action == "drop":
            if col in fills:
                needs.append(fills[col].number)
            elif col not in passed:
                passed.append(col)
        elif col not in fills and _fills(df, col, action):
            fills[col] = Fill(len(fills), col, action, tuple(passed), tuple(needs))
    if not fills and not passed and columns == df.columns:
        return df
    return _cleaned(df, list(fills.values()), passed, needs, columns, method)
