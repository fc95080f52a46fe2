"""The seven analysis operations (A1-A7), each one lazy DataFrame.

Every operation reads only the columns it needs (Catalyst prunes the scan)
and aggregates with Spark's partial/final aggregation, so the shuffle carries
one partial row per task and group, whatever the group sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (as_double, clean_value, field, is_missing,
                                 is_numeric, numeric_columns, qcol, safe_corr)
from ..functions.dates import FREQS, as_timestamp, best_format, parse_by_number, period_label
from ..functions.masks import to_double
from .comoments import pair_correlations
from .common import is_identifier, long_rows, message_frame, require_columns
from .quantiles import column_quantiles, quantile_frame

DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
WIDE = 40  # beyond so many columns statistics are taken over rows (column, value)
FEW_COLUMNS = 10  # up to so many columns one aggregation holds all pairs
GROUP_AGGS = ("mean", "sum", "min", "max", "median", "count")


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls (and NaN) per column: ``(column_name, missing)``, one pass."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column_name string, missing bigint")
    exprs = [F.count_if(is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)]
    agg = df.agg(*exprs)
    return long_rows(agg, [(c,) for c in df.columns],
                     [F.col(f"_m{i}").cast("bigint") for i in range(len(df.columns))],
                     ["column_name"], "missing")


def describe_numeric(df: DataFrame, columns=None, method: str = "exact") -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, as
    ``(column_name, stat, value)``.

    Moments and bounds share one aggregation; the quartiles of all columns
    share the scans of :mod:`quantiles` (``method``: exact with bounded
    memory, Spark ``percentile`` or ``approx``). Given only
    text/boolean columns, the categorical description is returned instead.
    """
    cols = require_columns(df, columns) if columns else numeric_columns(df)
    if not cols:
        return message_frame(df.sparkSession, "No numeric columns available")
    num = [c for c in cols if is_numeric(field(df, c).dataType)]
    if not num:
        return describe_categorical(df, cols)
    q = column_quantiles(df, num, [0.25, 0.5, 0.75], method)
    quart = q.select("column_name", F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col("q")[i].alias("value"))
        for i, s in enumerate(("25%", "50%", "75%"))])))
    if len(num) > WIDE:
        return _moments_by_rows(df, num).unionByName(quart)
    exprs = []
    for i, c in enumerate(num):
        x = as_double(df, c)
        exprs += [F.count(x).cast("double").alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                  F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                  F.max(x).alias(f"hi{i}")]
    # moments stay in a codegen'd aggregation of their own (an object
    # aggregate such as percentile would take the whole aggregation out of
    # whole-stage codegen)
    agg = df.agg(*exprs)
    rows, vals = [], []
    for i, c in enumerate(num):
        for stat, v in (("count", f"n{i}"), ("mean", f"a{i}"), ("std", f"s{i}"),
                        ("min", f"lo{i}"), ("max", f"hi{i}")):
            rows.append((c, stat))
            vals.append(F.col(v).cast("double"))
    moments = long_rows(agg, rows, vals, ["column_name", "stat"], "value")
    return moments.unionByName(quart)


def _moments_by_rows(df: DataFrame, num: list[str]) -> DataFrame:
    """Count, mean, std, min and max of many columns, taken as rows (column, value): generated code
    doesn't grow with the columns."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), as_double(df, c).alias("x")) for i, c in enumerate(num)])))
    stats = {"count": F.count("x").cast("double"), "mean": F.avg("x"), "std": F.stddev_samp("x"),
             "min": F.min("x"), "max": F.max("x")}
    each = long.groupBy("_k").agg(*[v.alias(s) for s, v in stats.items()])
    names = df.sparkSession.createDataFrame(list(enumerate(num)), "_k int, column_name string")
    found = names.join(F.broadcast(each), "_k", "left").withColumn("count", F.coalesce("count", F.lit(0.0)))
    return found.select("column_name", F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats])))


def frequency_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value, n)``: non-null value counts of several columns in
    one shuffle. Values are compared as text, whatever their length; NaN counts
    as missing.

    The unpivot is a projection; the aggregation combines map-side, so a hot
    value costs one partial row per task, not one row per occurrence.
    """
    pairs = []
    for c in columns:
        v = clean_value(df, c).cast("string")
        pairs.append(F.struct(F.lit(c).alias("column_name"), v.alias("value")))
    long = df.select(F.inline(F.array(*pairs)))
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def describe_categorical(df: DataFrame, columns) -> DataFrame:
    """count, unique, top, freq per column as ``(column_name, stat, value)``
    with text values; the top value is the most frequent, smallest on ties."""
    cols = require_columns(df, columns)
    freq = frequency_table(df, cols)
    per = freq.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))
    # a column without values still has its row: count 0
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    per = names.join(per, "column_name", "left").withColumns({
        "count": F.coalesce("count", F.lit(0)), "unique": F.coalesce("unique", F.lit(0))})
    stats = ["count", "unique", "top", "freq"]
    return per.select("column_name", F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value"))
        for s in stats])))


def value_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Top-n values of a column with counts, nulls excluded: ``(value, count)``.

    Ordered by count descending, then value ascending (deterministic ties).
    ``orderBy().limit()`` plans a TakeOrderedAndProject: each task keeps its
    own top-n, so no task ever sorts the whole frequency table.
    """
    if not isinstance(column, str) or column not in df.columns:
        return message_frame(df.sparkSession, "Invalid column for value_counts")
    if not isinstance(top_n, int) or isinstance(top_n, bool) or top_n < 1:
        raise ValueError(f"top_n must be a positive whole number, not {top_n!r}")
    counts = frequency_table(df, [column]).withColumnRenamed("n", "count")
    top = counts.orderBy(F.col("count").desc(), F.col("value").asc()).limit(top_n)
    return top.select("value", "count")


def correlation_matrix(df: DataFrame, columns=None, max_columns: int | None = None) -> DataFrame:
    """Pearson correlation of every pair, pairwise complete, as ``(x, y, r)``.

    Up to ``FEW_COLUMNS`` columns all pairs are guarded expressions of one aggregation; more
    columns come from the co-moment blocks of :mod:`comoments`, whose plan doesn't grow with them. A
    constant column and one with an infinity give NULL (never a division error). The diagonal
    is 1.0 for columns with at least two distinct values, NULL otherwise. A name given twice counts once.
    """
    cols = require_columns(df, columns) if columns else numeric_columns(df)
    cols = [c for c in dict.fromkeys(cols) if is_numeric(field(df, c).dataType, include_bool=True)]
    if max_columns:
        cols = cols[:max_columns]
    if len(cols) < 2:
        return message_frame(df.sparkSession, "Not enough numeric columns for correlation")
    if len(cols) > FEW_COLUMNS:
        return _by_blocks(df, cols)
    exprs, rows, vals = correlation_parts(df, cols)
    return long_rows(df.agg(*exprs), rows, vals, ["x", "y"], "r")


def correlation_parts(df: DataFrame, cols: list[str]) -> tuple[list, list[tuple[str, str]], list]:
    """Aggregates over the table, and the pairs and their correlations made from the results."""
    xs = {c: as_double(df, c) for c in cols}
    exprs, keys = [], {}
    for i, a in enumerate(cols):
        exprs.append(F.stddev_samp(xs[a]).alias(f"d{i}"))
        for j in range(i + 1, len(cols)):
            keys[(i, j)] = f"r{i}_{j}"
            exprs.append(safe_corr(xs[a], xs[cols[j]]).alias(keys[(i, j)]))
    rows, vals = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            rows.append((a, b))
            if i == j:
                vals.append(F.when((F.col(f"d{i}") > 0) & ~F.isnan(f"d{i}"), F.lit(1.0)))
            else:
                vals.append(F.nanvl(F.col(keys[(min(i, j), max(i, j))]), F.lit(None).cast("double")))
    return exprs, rows, [v.cast("double") for v in vals]


def _by_blocks(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x, y, r)`` of all pairs from co-moments; every pair has its row, also of an empty table."""
    k = len(cols)
    name = F.array(*[F.lit(c) for c in cols])
    grid = df.sparkSession.range(k * k).select(
        F.expr(f"int(id div {k})").alias("a"), F.expr(f"int(id % {k})").alias("b"))
    found = pair_correlations(df, cols)  # a row per pair of columns
    return grid.join(found, (F.least("a", "b") == F.col("i")) & (F.greatest("a", "b") == F.col("j")), "left").select(
        F.get(name, F.col("a")).alias("x"), F.get(name, F.col("b")).alias("y"), "r")


def groupby_agg(df: DataFrame, by: str, target: str, agg: str = "mean",
                method: str = "exact") -> DataFrame:
    """One aggregate of ``target`` per value of ``by``: ``(by, <agg>)``.

    Null and NaN keys are dropped; ``sum`` of an all-null group is 0 and NULL if
    it overflows, every other aggregate of an all-null group is NULL. Unknown ``agg`` falls back to ``mean``. The
    median is exact with bounded memory per task (a hot group is split by
    value buckets, see :mod:`quantiles`).
    """
    spark = df.sparkSession
    if not is_identifier(by) or by not in df.columns:
        return message_frame(spark, "Invalid group-by column")
    if not is_identifier(target) or target not in df.columns:
        return message_frame(spark, "Invalid target column")
    if agg not in GROUP_AGGS:
        agg = "mean"
    dt = field(df, target).dataType
    numeric = is_numeric(dt, include_bool=True)
    if agg in ("mean", "median", "sum") and not numeric:
        raise ValueError(f"groupby {agg} needs a numeric target, {target} is {dt.simpleString()}")
    x = as_double(df, target) if agg in ("mean", "median") else clean_value(df, target)
    keyed = df.where(~is_missing(df, by))
    if agg == "median":
        base = keyed.select(qcol(by).alias(by), x.alias("_v"))
        groups = base.groupBy(by).agg(F.count(F.lit(1)).alias("_rows"))
        med = quantile_frame(base, "_v", [0.5], method, [by])
        return groups.join(med, by, "left").select(by, F.col("q")[0].alias("median"))
    if agg == "mean":
        e = F.avg(x)
    elif agg == "sum":
        s = F.try_sum(x.cast("int") if isinstance(dt, T.BooleanType) else x)  # NULL on overflow
        e = F.when(F.count(x) > 0, s).otherwise(F.lit(0).cast(s_type(dt)))
    elif agg == "min":
        e = F.min(x)
    elif agg == "max":
        e = F.max(x)
    else:
        e = F.count(x)
    return keyed.groupBy(qcol(by).alias(by)).agg(e.alias(agg))


def s_type(dt: T.DataType) -> str:
    """Result type of ``sum`` over a column of type ``dt``."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "bigint"
    if isinstance(dt, T.DecimalType):
        return T.DecimalType(min(38, dt.precision + 10), dt.scale).simpleString()
    return "double"


def anomaly_detection(df: DataFrame, column: str, z_threshold: float = 3.0) -> DataFrame:
    """z-score outliers of a numeric column, summarised in one row.

    z = (x - mean) / std (sample std); a row is a hit when |z| >= threshold.
    ``percentage`` is the share of *all* rows, rounded half-even to 2
    places. With zero or undefined std a message row is returned instead.
    Two passes over the column: the statistics are a one-row aggregate that
    is broadcast (its size is one row by construction) into the second.
    """
    spark = df.sparkSession
    if not isinstance(column, str) or column not in df.columns:
        return message_frame(spark, "Invalid numeric column for anomaly detection")
    if not is_numeric(field(df, column).dataType, include_bool=True):
        return message_frame(spark, "Anomaly detection requires numeric column")
    thr = float(z_threshold)
    x = as_double(df, column).alias("x")
    base = df.select(x)
    stats = base.agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"),
                     F.count(F.lit(1)).alias("n_all"))
    j = base.crossJoin(F.broadcast(stats))
    z = F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))
    hit = ~F.isnan(z) & (F.abs(z) >= F.lit(thr))
    hx = F.when(hit, F.col("x"))
    # a global aggregate: one row even for an empty input; an infinity has no z-score, and with
    # one among the values the deviation is NaN: no variance to judge by
    res = j.agg(
        F.max("sd").alias("sd"), F.max("n_all").alias("n_all"),
        F.count_if(F.coalesce(hit, F.lit(False))).alias("cnt"),
        F.min(hx).alias("lo"), F.max(hx).alias("hi"), F.avg(hx).alias("av"),
        F.stddev_samp(hx).alias("sd_hit"))
    ok = F.col("sd").isNotNull() & ~F.isnan("sd") & (F.col("sd") != 0)
    cnt = F.coalesce(F.col("cnt"), F.lit(0))
    return res.select(
        F.lit(column).alias("column_name"),
        F.lit(thr).alias("threshold"),
        F.when(ok, cnt).cast("bigint").alias("count"),
        F.when(ok, F.bround(cnt * 100.0 / F.col("n_all"), 2)).alias("percentage"),
        F.when(ok, F.col("lo")).alias("min_anomaly"),
        F.when(ok, F.col("hi")).alias("max_anomaly"),
        F.when(ok, F.col("av")).alias("mean_anomaly"),
        F.when(ok, F.col("sd_hit")).alias("std_anomaly"),
        F.when(~ok, F.lit("Insufficient variance for anomaly detection")).alias("message"))


def time_series_trend(df: DataFrame, date_column: str, value_column: str,
                      freq: str = "M") -> DataFrame:
    """Mean of a value per period: ``(period, mean)``.

    Text dates are read in the one format that fits most of them; unparsable
    dates and values are dropped, empty periods do not appear.
    Labels: D day start; W the Sunday ending the week; M/Q/Y last day of
    the period. ``freq`` outside D/W/M/Q/Y means M.
    """
    spark = df.sparkSession
    if not isinstance(date_column, str) or date_column not in df.columns:
        return message_frame(spark, "Invalid date_column")
    if not isinstance(value_column, str) or value_column not in df.columns:
        return message_frame(spark, "Invalid value_column")
    freq = freq if freq in FREQS else "M"
    if isinstance(field(df, date_column).dataType, T.StringType):
        # one row: which of the known formats most texts have
        df = df.crossJoin(F.broadcast(df.agg(best_format(qcol(date_column)).alias("_format"))))
        d = parse_by_number(qcol(date_column), F.col("_format"))
    else:
        d = as_timestamp(df, date_column)
    vdt = field(df, value_column).dataType
    v = as_double(df, value_column) if is_numeric(vdt, True) else to_double(qcol(value_column))
    pts = df.select(d.alias("d"), v.alias("v")).where(
        F.col("d").isNotNull() & F.col("v").isNotNull())
    return pts.groupBy(period_label(F.col("d"), freq).alias("period")) \
        .agg(F.avg("v").alias("mean"))
