"""Table profile (P1-P9): one row per column, computed in three scans.

Scan 1 is a single global aggregation holding every per-column statistic that needs no
values side by side: missing counts, moments, bounds. Scan 2 is the typed frequency table of
numbers and times, ``(column, double, exact, n)``: the value as a double and, where
doubles can't tell values apart (64-bit whole numbers, decimals, times), as a whole number
too. It gives distinct counts and, narrowed by rank, the medians. Scan 3 is the frequency table
``(column, value, n)`` of texts, for distinct counts, top values, and the share of rows that parse
with each candidate datetime format (each distinct value is parsed once, weighted by
its count). All pieces have one row per column, so the final joins are
broadcast joins whose size is bounded by the schema width.

What reads a frequency table reads its counts as well and filters on nothing but results, so
that Spark recognises the shuffle as the same and runs it once.

The column class is decided inside the plan (a CASE over the parse ratio),
so ``profile`` runs no action and stays one lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (CATEGORICAL_CLASS, DATETIME_CLASS, DATETIME_LIKE_CLASS,
                                 NUMERIC_CLASS, OTHER_CLASS, as_double, clean_value, is_datetime,
                                 is_missing, is_numeric, qcol, type_name)
from ..functions.dates import DATETIME_FORMATS, parse_datetime
from .analysis import WIDE, frequency_table
from .quantiles import column_quantiles, exact_quantiles

DATETIME_RATIO = 0.8
TOP_K = 5


def schema_class(dt: T.DataType) -> str | None:
    """Class known from the type alone; ``None`` for text (decided by data)."""
    if is_numeric(dt, include_bool=True):
        return NUMERIC_CLASS
    if is_datetime(dt):
        return DATETIME_CLASS
    if isinstance(dt, T.StringType):
        return None
    return OTHER_CLASS


def stats_parts(df: DataFrame, approx_distinct: bool = False) -> tuple[list[Column], list[Column]]:
    """Aggregates over the table, and one struct per column made from their results: every
    statistic that needs no shuffle of values."""
    exprs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    rows = []
    for i, f in enumerate(df.schema.fields):
        name, dt = f.name, f.dataType
        base = schema_class(dt)
        exprs.append(F.count_if(is_missing(df, name)).alias(f"m{i}"))
        uniq = F.lit(None).cast("bigint")
        if approx_distinct and base != OTHER_CLASS:
            exprs.append(F.approx_count_distinct(clean_value(df, name)).alias(f"u{i}"))
            uniq = F.col(f"u{i}")
        mean = median = var = lo = hi = F.lit(None).cast("double")
        dlo = dhi = F.lit(None).cast("timestamp_ntz")
        if base == NUMERIC_CLASS:
            x = as_double(df, name)
            exprs += [F.avg(x).alias(f"a{i}"), F.var_samp(x).alias(f"v{i}"),
                      F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            mean, var = F.col(f"a{i}"), F.col(f"v{i}")
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        elif base == DATETIME_CLASS:
            exprs += [F.min(qcol(name)).cast("timestamp_ntz").alias(f"dlo{i}"),
                      F.max(qcol(name)).cast("timestamp_ntz").alias(f"dhi{i}")]
            dlo, dhi = F.col(f"dlo{i}"), F.col(f"dhi{i}")
        rows.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(i).alias("position"),
            F.lit(type_name(dt)).alias("type"),
            F.lit(base).cast("string").alias("base_class"),
            F.col(f"m{i}").cast("bigint").alias("num_missing"),
            uniq.cast("bigint").alias("approx_unique"),
            mean.cast("double").alias("mean"), median.cast("double").alias("median"),
            var.cast("double").alias("variance"), lo.cast("double").alias("min"),
            hi.cast("double").alias("max"),
            dlo.cast("timestamp_ntz").alias("dt_min"), dhi.cast("timestamp_ntz").alias("dt_max")))
    return exprs, rows


def stats_rows(agg: DataFrame, rows: list[Column]) -> DataFrame:
    """The one aggregated row as one row per column."""
    if not rows:
        return agg.select(F.col("n_rows")).where(F.lit(False))
    return agg.select("n_rows", F.inline(F.array(*rows)))


def _stats_frame(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Scan 1: one row per column (all columns share one aggregation)."""
    if len(df.columns) > WIDE:
        return _stats_by_rows(df, approx_distinct)
    exprs, rows = stats_parts(df, approx_distinct)
    return stats_rows(df.agg(*exprs), rows)


def _stats_by_rows(df: DataFrame, approx_distinct: bool) -> DataFrame:
    """The same of many columns, taken as rows (column, value): generated code doesn't grow with the columns."""
    none, never = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    items, names = [], []
    for i, f in enumerate(df.schema.fields):
        base = schema_class(f.dataType)
        text = clean_value(df, f.name).cast("string") if approx_distinct and base != OTHER_CLASS else F.lit(None).cast("string")
        items.append(F.struct(
            F.lit(i).alias("position"), is_missing(df, f.name).alias("gap"),
            (as_double(df, f.name) if base == NUMERIC_CLASS else none).alias("x"),
            (qcol(f.name).cast("timestamp_ntz") if base == DATETIME_CLASS else never).alias("t"), text.alias("text")))
        names.append((f.name, i, type_name(f.dataType), base))
    each = df.select(F.inline(F.array(*items))).groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("gap").alias("num_missing"), F.approx_count_distinct("text").alias("u"),
        F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.min("t").alias("dt_min"), F.max("t").alias("dt_max"))
    columns = df.sparkSession.createDataFrame(names, "column_name string, position int, type string, base_class string")
    unique = F.when(F.coalesce("base_class", F.lit("")) != OTHER_CLASS, F.col("u")) if approx_distinct else F.lit(None)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return columns.join(F.broadcast(each), "position", "left").select(
        zero(F.col("n")).alias("n_rows"), "column_name", "position", "type", "base_class",
        zero(F.col("num_missing")).alias("num_missing"), unique.cast("bigint").alias("approx_unique"), "mean",
        none.alias("median"), "variance", "min", "max", "dt_min", "dt_max")


def _text_facts(freq: DataFrame, formats=DATETIME_FORMATS) -> DataFrame:
    """``(column_name, num_unique_t, c<k>, pl<k>, ph<k>)``: distinct texts, and for format k the rows
    that parse and their bounds. Each *distinct* value is parsed, once per format."""
    v = F.col("value")
    exprs = [F.count_if(F.col("n") > 0).alias("num_unique_t")]
    for k, fm in enumerate(formats):
        p = parse_datetime(v, fm)
        exprs += [F.sum(F.when(p.isNotNull(), F.col("n"))).alias(f"c{k}"),
                  F.min(p).alias(f"pl{k}"), F.max(p).alias(f"ph{k}")]
    return freq.groupBy("column_name").agg(*exprs)


def _best_format(n_rows: Column, formats=DATETIME_FORMATS) -> Column:
    """Struct (ratio, -index, fmt, lo, hi) of the best format: highest share
    of all rows that parse, the earliest listed format on ties."""
    cands = []
    for k, fm in enumerate(formats):
        share = F.try_divide(F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("double"), n_rows)
        cands.append(F.struct(F.coalesce(share, F.lit(0.0)).alias("ratio"),
                              F.lit(-k).alias("neg_idx"),
                              F.lit(fm if fm else "iso8601").alias("fmt"),
                              F.col(f"pl{k}").alias("lo"), F.col(f"ph{k}").alias("hi")))
    return F.greatest(*cands) if len(cands) > 1 else cands[0]


def _typed(df: DataFrame, name: str) -> Column:
    """A number or time as struct (x, exact, text): together they tell all values of the column apart.

    ``x``: a number as a double, NULL for a time; ``exact``: the value as a whole number where doubles
    lose digits; ``text``: the value as text where that loses some too (decimals of over 18 digits).
    """
    dt = df.schema[name].dataType
    c, exact = clean_value(df, name), F.lit(0).cast("long")
    text = F.lit(None).cast("string")
    x = as_double(df, name) if is_numeric(dt, include_bool=True) else F.lit(None).cast("double")
    if isinstance(dt, T.DecimalType) and dt.precision > 18:
        text = c.cast("string")
    elif isinstance(dt, T.DecimalType):
        exact = (c * F.lit(10 ** dt.scale).cast(T.DecimalType(19, 0))).cast("long")
    elif isinstance(dt, T.LongType):
        exact = c
    elif isinstance(dt, T.TimestampNTZType):
        exact = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    elif isinstance(dt, T.TimestampType):
        exact = F.unix_micros(c)
    elif isinstance(dt, T.DateType):
        exact = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    return F.when(c.isNotNull(), F.struct(x.alias("x"), exact.alias("exact"), text.alias("text")))


def number_frequency(df: DataFrame) -> DataFrame:
    """``(position, x, exact, text, n)`` over numeric and datetime columns."""
    names = df.columns
    positions = [i for i, f in enumerate(df.schema.fields)
                 if schema_class(f.dataType) in (NUMERIC_CLASS, DATETIME_CLASS)]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), _typed(df, names[i]).alias("v"))
                                        for i in positions])))
    return long.where(F.col("v").isNotNull()).groupBy("position", "v.x", "v.exact", "v.text").agg(
        F.count(F.lit(1)).alias("n"))


def _distinct_numbers(freq: DataFrame) -> DataFrame:
    return freq.groupBy("position").agg(F.count_if(F.col("n") > 0).alias("num_unique_n"))


def _medians(freq: DataFrame) -> DataFrame:
    """``(position, median_q)`` of the numeric columns of a table of frequencies."""
    values = freq.select("position", F.when(F.col("n") > 0, F.col("x")).alias("x"), "n")
    return exact_quantiles(values, ["position"], "x", [0.5], small_keys=True, weight="n").select(
        "position", F.col("q")[0].alias("median_q"))


def _top(freq: DataFrame, top_k: int) -> DataFrame:
    """Top-k values per column of a frequency table as an array column.

    ``row_number() <= k`` over the frequency table is planned with a partial
    WindowGroupLimit before the exchange, so each column's window partition
    receives at most k rows per task however many distinct values it has.
    """
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc())
    ranked = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return ranked.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("value").alias("value"),
        F.col("n").cast("bigint").alias("count")))).alias("top_values"))


def top_values(df: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """``(column_name, rank, value, count)``: the k most frequent values of
    every text column (count descending, value ascending on ties)."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, rank int, value string, count bigint")
    return _top(frequency_table(df, text_cols), top_k).select("column_name", F.inline("top_values"))


def profile(df: DataFrame, top_k: int = TOP_K, approx_distinct: bool = False,
            quantile_method: str = "exact", stats: DataFrame | None = None, numbers: DataFrame | None = None,
            texts: DataFrame | None = None) -> DataFrame:
    """Full profile, one row per column.

    Columns: column_name, position, type, class (numeric / datetime /
    datetime_like / categorical / other), num_missing, num_unique, mean,
    median, variance, min, max (numeric), datetime_min, datetime_max,
    datetime_ratio, datetime_format (text), top_values (categorical only),
    num_rows, num_cols.

    Three pieces, all lazy: the statistics aggregation; the typed frequency table of
    numbers and times giving distinct counts and exact medians; the text frequency
    table giving distinct counts, top values and datetime detection. Each
    piece has one row per column and is joined by broadcast (size bounded
    by the schema width). ``approx_distinct`` replaces exact distinct counts
    by HyperLogLog sketches; ``quantile_method`` as in :mod:`quantiles`. The three pieces
    can be given (``stats``, ``numbers``, ``texts``), as stored by :mod:`facts`.
    """
    fields = df.schema.fields
    num_pos = [i for i, f in enumerate(fields) if schema_class(f.dataType) == NUMERIC_CLASS]
    dt_pos = [i for i, f in enumerate(fields) if schema_class(f.dataType) == DATETIME_CLASS]
    names = df.columns
    text_cols = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    out = _stats_frame(df, approx_distinct) if stats is None else stats

    shared = numbers
    if shared is None and (num_pos or dt_pos) and not approx_distinct:
        shared = number_frequency(df)
    if shared is not None:
        out = out.join(F.broadcast(_distinct_numbers(shared)), "position", "left")
    if num_pos:
        if shared is not None and quantile_method == "exact":
            med = _medians(shared)
        else:
            med = column_quantiles(df, [names[i] for i in num_pos], [0.5], quantile_method).select(
                F.element_at(F.array(*[F.lit(i) for i in num_pos]), F.col("_k") + 1).alias("position"),
                F.col("q")[0].alias("median_q"))
        out = out.join(F.broadcast(med), "position", "left").withColumn("median", F.coalesce("median", "median_q"))
    if text_cols:
        tf = frequency_table(df, text_cols) if texts is None else texts
        facts = _text_facts(tf)
        if approx_distinct:
            facts = facts.drop("num_unique_t")
        out = out.join(F.broadcast(facts), "column_name", "left").join(
            F.broadcast(_top(tf, top_k)), "column_name", "left")
        best = _best_format(F.col("n_rows").cast("double"))
    else:
        best = F.struct(F.lit(None).cast("double").alias("ratio"),
                        F.lit(None).cast("string").alias("fmt"),
                        F.lit(None).cast("timestamp_ntz").alias("lo"),
                        F.lit(None).cast("timestamp_ntz").alias("hi"))
        out = out.withColumn("top_values", F.lit(None).cast(
            "array<struct<rank:int,value:string,count:bigint>>"))
    for c in ("num_unique_n", "num_unique_t"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("bigint"))
    out = out.withColumn("_best", F.when(F.col("base_class").isNull(), best))
    is_dt = F.col("_best.ratio") >= F.lit(DATETIME_RATIO)
    klass = F.coalesce(F.col("base_class"),
                       F.when(is_dt, F.lit(DATETIME_LIKE_CLASS)).otherwise(F.lit(CATEGORICAL_CLASS)))
    uniq = F.coalesce("approx_unique", "num_unique_n", "num_unique_t",
                      F.when(F.coalesce("base_class", F.lit("")) != OTHER_CLASS, F.lit(0)))
    return out.select(
        "column_name", "position", "type", klass.alias("class"), "num_missing",
        uniq.cast("bigint").alias("num_unique"),
        "mean", "median", "variance", "min", "max",
        F.coalesce(F.col("dt_min"), F.when(is_dt, F.col("_best.lo"))).alias("datetime_min"),
        F.coalesce(F.col("dt_max"), F.when(is_dt, F.col("_best.hi"))).alias("datetime_max"),
        F.col("_best.ratio").cast("double").alias("datetime_ratio"),
        F.when(is_dt, F.col("_best.fmt")).alias("datetime_format"),
        F.when(klass == CATEGORICAL_CLASS, F.col("top_values")).alias("top_values"),
        F.col("n_rows").cast("bigint").alias("num_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("num_cols"))


# what any date or time in a known format is made of; other texts needn't be tried
DATE_SHAPE_RE = r"^\s*(?=[^0-9]{0,12}[0-9])[0-9A-Za-z\s,:/.+_\[\]-]+$"


def classes(df: DataFrame) -> DataFrame:
    """``(column_name, position, type, class)`` only: the schema decides all
    but text columns, whose share of texts that parse as dates is counted
    map-side, all columns and formats in one aggregation."""
    fields = df.schema.fields
    exprs = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        if schema_class(f.dataType) is None:
            text = F.when(qcol(f.name).rlike(DATE_SHAPE_RE), qcol(f.name))
            exprs += [F.count(parse_datetime(text, fm)).alias(f"d{i}_{k}") for k, fm in enumerate(DATETIME_FORMATS)]

    def klass(i: int, dt: T.DataType) -> Column:
        if schema_class(dt) is not None:
            return F.lit(schema_class(dt))
        most = F.greatest(*[F.col(f"d{i}_{k}") for k in range(len(DATETIME_FORMATS))])
        share = F.try_divide(most.cast("double"), F.col("n_rows").cast("double"))
        return F.when(share >= F.lit(DATETIME_RATIO), F.lit(DATETIME_LIKE_CLASS)).otherwise(F.lit(CATEGORICAL_CLASS))

    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                     F.lit(type_name(f.dataType)).alias("type"), klass(i, f.dataType).alias("class"))
            for i, f in enumerate(fields)]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, position int, type string, class string")
    return df.agg(*exprs).select(F.inline(F.array(*rows)))


def profile_shape(df: DataFrame) -> DataFrame:
    """``(num_rows, num_cols)``."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("num_rows")) \
        .select("num_rows", F.lit(len(df.columns)).cast("bigint").alias("num_cols"))


def column_stats(df: DataFrame) -> DataFrame:
    """Scan-1 statistics only (no frequency tables, so no median and no
    distinct counts): one row per column with missing counts, numeric
    moments and bounds, datetime bounds."""
    return _stats_frame(df)


def unique_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(column_name, num_unique)``: distinct non-null values per column; NULL for nested types."""
    if approx:
        return profile(df, approx_distinct=True).select("column_name", "num_unique")
    fields = df.schema.fields
    numbers = [i for i, f in enumerate(fields) if schema_class(f.dataType) in (NUMERIC_CLASS, DATETIME_CLASS)]
    texts = [f.name for f in fields if schema_class(f.dataType) is None]
    names = [(f.name, i, schema_class(f.dataType) == OTHER_CLASS) for i, f in enumerate(fields)]
    out = df.sparkSession.createDataFrame(names, "column_name string, position int, _other boolean")
    found = F.lit(None).cast("bigint")
    if numbers:
        out = out.join(F.broadcast(_distinct_numbers(number_frequency(df))), "position", "left")
        found = F.coalesce(found, "num_unique_n")
    if texts:
        each = frequency_table(df, texts).groupBy("column_name").agg(F.count_if(F.col("n") > 0).alias("num_unique_t"))
        out = out.join(F.broadcast(each), "column_name", "left")
        found = F.coalesce(found, "num_unique_t")
    return out.select("column_name", F.when(~F.col("_other"), F.coalesce(found, F.lit(0))).cast("bigint").alias("num_unique"))
