"""Exact quantiles (linear interpolation) with bounded work per task, by one method.

Spark's ``percentile`` keeps a value->count map per group and merges all of
a group's maps in one task, so its memory grows with the number of distinct
values. ``exact_quantiles`` computes the same numbers (same interpolation
arithmetic) by narrowing the value range around the wanted ranks:

1. counts, least and largest value per (key, magnitude), a magnitude being the
   sign and the binary exponent, zero or an infinity: the cut doesn't depend on
   the data, so one huge value or an infinity can't crowd all others into a cell;
2. the few magnitudes that hold a wanted rank are cut into 4096 equal
   widths between their own least and largest value, and counted again;
3. the values of the cells found are counted one by one (shuffled by value, so that
   even crowded cells are spread), and cut into 4096 widths once more;
4. the values of the cells left are ranked.

Steps 1 to 3 are scans with a map-side aggregate; input rows are not
shuffled when the keys are few (columns): the cells found, at most two for
each probability and key, are broadcast. A hot value or key only raises
counters. With many keys the cells found are joined by key, by whichever join
Spark's own size checks choose.

``percentile`` (one pass, memory grows) and ``approx`` (``percentile_approx``, a
bounded sketch) can be asked for by name; nothing picks them by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("exact", "percentile", "approx")
APPROX_ACCURACY = 10000
CELLS = 4096
INFINITE = 5000


def _magnitude(x: Column) -> Column:
    """Sign and binary exponent as one number that never falls as ``x`` rises."""
    exponent = F.floor(F.log2(F.abs(x))) + 1100  # 26 and above for every double but zero
    size = F.when(F.abs(x) == F.lit(float("inf")), F.lit(INFINITE)).otherwise(exponent)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def _equal_width(x: Column, lo: Column, hi: Column) -> Column:
    """Which of ``CELLS`` equal widths between ``lo`` and ``hi`` holds ``x``."""
    return F.when(lo == hi, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))).cast("int")


def _ranks(probs: list[float], n: Column) -> list[Column]:
    """The two 0-based ranks between which each probability lies."""
    low = [F.floor(F.lit(p) * (n - 1)) for p in probs]
    return [r for k in low for r in (k, F.least(k + 1, n - 1))]


def _holds(probs: list[float], first: Column, end: Column) -> Column:
    wanted = F.lit(False)
    for r in _ranks(probs, F.col("_n")):
        wanted = wanted | ((r >= first) & (r < end))
    return wanted


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: list[float],
                    small_keys: bool = False, weight: str | None = None) -> DataFrame:
    """``(*keys, q)``: quantiles of the values of ``x`` per key, without nulls and NaN.

    Keys without values get no row; with no keys there is one row always. ``weight``: a column
    that says how often each row's value stands (of a table of frequencies).
    ``small_keys``: the number of keys is bounded by the schema (column numbers),
    so the cells found are broadcast; otherwise Spark chooses the join.
    """
    probs = [float(p) for p in probs]
    kc = [F.col(f"`{k}`") for k in keys]
    hint = F.broadcast if small_keys or not keys else (lambda t: t)
    times = F.col(weight) if weight else F.lit(1)
    rows = df.select(*kc, F.col(x).cast("double").alias("_x"), times.cast("long").alias("_c")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x"))
    # _at: rank of the first value of the cell that a row is in, which names the cell
    rows = rows.withColumns({"_at": F.lit(0).cast("long"), "_cell": _magnitude(F.col("_x"))})
    for cut in ("magnitude", "width", "width again"):
        if cut == "width again":  # few values are left, unless they crowd: count each once, spread by value
            rows = rows.groupBy(*kc, "_at", "_cell", "_n", "_x").agg(F.sum("_c").alias("_c"))
        counted = rows.groupBy(*kc, "_at", "_cell").agg(
            F.sum("_c").alias("_cc"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
            *([] if cut == "magnitude" else [F.min("_n").alias("_n")]))
        run = Window.partitionBy(*kc, "_at").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        if cut == "magnitude":
            counted = counted.withColumn("_n", F.sum("_cc").over(Window.partitionBy(*kc)))
        found = counted.withColumn("_end", F.col("_at") + F.sum("_cc").over(run)).withColumn(
            "_first", F.col("_end") - F.col("_cc")).where(_holds(probs, F.col("_first"), F.col("_end")))
        found = found.select(*kc, "_at", "_cell", "_first", "_lo", "_hi", "_n")
        rows = rows.drop("_n").join(hint(found), [*keys, "_at", "_cell"]).select(
            *kc, "_x", "_c", F.col("_first").alias("_at"), "_n",
            _equal_width(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_cell"))
    values = rows
    run = Window.partitionBy(*kc, "_at").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_end", F.col("_at") + F.sum("_c").over(run)).withColumn(
        "_first", F.col("_end") - F.col("_c"))
    picks = [F.max(F.when((r >= F.col("_first")) & (r < F.col("_end")), F.col("_x"))).alias(f"_v{i}")
             for i, r in enumerate(_ranks(probs, F.col("_n")))]
    agg = values.groupBy(*kc) if keys else values
    return agg.agg(F.max("_n").alias("_n"), *picks).select(*kc, _interpolate(probs).alias("q"))


def _interpolate(probs: list[float]) -> Column:
    """Linear interpolation between the values at floor/ceil of p(n-1), in
    the same arithmetic as Spark's ``percentile``."""
    qs = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        mixed = (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi
        qs.append(F.when((F.ceil(pos) == F.floor(pos)) | (lo == hi), lo).otherwise(mixed))
    return F.array(*qs)


def _one_pass(x: Column, probs: list[float], method: str) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown quantile method {method!r}")
    return (F.percentile_approx(x, probs, APPROX_ACCURACY) if method == "approx"
            else F.percentile(x, F.array(*[F.lit(p) for p in probs])))


def quantile_frame(df: DataFrame, x: str, probs: list[float], method: str = "exact",
                   keys: list[str] | None = None, small_keys: bool = False) -> DataFrame:
    """``(*keys, q)`` by any method (see module doc)."""
    keys, probs = list(keys or []), [float(p) for p in probs]
    if method == "exact":
        return exact_quantiles(df, keys, x, probs, small_keys)
    e = _one_pass(F.col(x).cast("double"), probs, method)
    agg = df.groupBy(*keys).agg(e.alias("q")) if keys else df.agg(e.alias("q"))
    return agg.where(F.col("q").isNotNull()) if keys else agg


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     method: str = "exact") -> DataFrame:
    """``(_k, column_name, q)`` for several numeric columns (all share the scans)."""
    from ..functions.columns import as_double
    probs = [float(p) for p in probs]
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)],
                                            "_k int, column_name string")
    nulls = F.array(*[F.lit(None).cast("double") for _ in probs])
    if method == "exact":
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("_k"), as_double(df, c).alias("_v"))
            for i, c in enumerate(columns)])))
        q = exact_quantiles(long, ["_k"], "_v", probs, small_keys=True)
    else:
        aggs = [_one_pass(as_double(df, c), probs, method).alias(f"_q{i}") for i, c in enumerate(columns)]
        q = df.agg(*aggs).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("_k"), F.col(f"_q{i}").alias("q"))
            for i in range(len(columns))])))
    return names.join(F.broadcast(q), "_k", "left").select(
        "_k", "column_name", F.coalesce(F.col("q"), nulls).alias("q"))
