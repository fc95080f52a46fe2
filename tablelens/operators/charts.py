"""Chart data (V1-V6): aggregates only, never raw rows.

Histogram and box plot need the column range / quartiles first; those are
one-row aggregates joined back by broadcast (one row by construction), so
each chart is a single lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, field, is_numeric, numeric_columns
from .analysis import anomaly_detection, correlation_matrix, time_series_trend, value_counts
from .common import message_frame
from .quantiles import quantile_frame



def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram: ``(bucket, lower, upper, count)`` for buckets
    1..bins (empty buckets have count 0). The top edge belongs to the last
    bucket; a constant column puts everything in bucket 1. Infinite values have
    no place on an equal-width axis and are left out, as nulls and NaN are."""
    if column not in df.columns or not is_numeric(field(df, column).dataType, True):
        return message_frame(df.sparkSession, f"No numeric column {column!r}")
    bins = int(bins)
    x = df.select(as_double(df, column).alias("x")).where(
        F.col("x").isNotNull() & (F.abs("x") < F.lit(float("inf"))))
    rng = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width * bins) + 1, F.lit(bins)))
    counts = x.crossJoin(F.broadcast(rng)).groupBy(b.cast("int").alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bucket")) \
        .crossJoin(F.broadcast(rng)).where(F.col("lo").isNotNull())
    return grid.join(counts, "bucket", "left").select(
        "bucket",
        (F.col("lo") + (F.col("bucket") - 1) * width / bins).alias("lower"),
        F.when(F.col("bucket") == bins, F.col("hi"))
        .otherwise(F.col("lo") + F.col("bucket") * width / bins).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def box_plot(df: DataFrame, column: str, method: str = "exact") -> DataFrame:
    """Five-number summary with 1.5*IQR whiskers and the outlier count."""
    if column not in df.columns or not is_numeric(field(df, column).dataType, True):
        return message_frame(df.sparkSession, f"No numeric column {column!r}")
    x = df.select(as_double(df, column).alias("x")).where(F.col("x").isNotNull())
    q = quantile_frame(x, "x", [0.25, 0.5, 0.75], method)
    q = q.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                 F.col("q")[2].alias("q3"))
    q = q.withColumn("lf", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("uf", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = x.crossJoin(F.broadcast(q))
    inside = (F.col("x") >= F.col("lf")) & (F.col("x") <= F.col("uf"))
    res = j.agg(F.max("q1").alias("q1"), F.max("median").alias("median"),
                F.max("q3").alias("q3"), F.min("x").alias("min"), F.max("x").alias("max"),
                F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
                F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
                F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("count"))
    return res.select(F.lit(column).alias("column_name"), "count", "min", "q1", "median", "q3",
                      "max", "whisker_low", "whisker_high",
                      F.col("outliers").cast("bigint").alias("outliers"))


def bar_top(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Top categories of a column: ``(value, count)``."""
    return value_counts(df, column, top_n)


def heatmap(df: DataFrame, columns=None) -> DataFrame:
    """Correlation of all (or the given) numeric columns as ``(x, y, r)``."""
    return correlation_matrix(df, columns or numeric_columns(df))


def anomaly_bar(df: DataFrame, column: str, z_threshold: float = 3.0) -> DataFrame:
    """``(stat, value)`` for min / mean / max of the anomalies; no rows when
    there are none."""
    return anomaly_rows(anomaly_detection(df, column, z_threshold))


def anomaly_rows(found: DataFrame) -> DataFrame:
    """The bars of a result of ``anomaly_detection`` (its message, if it has no more)."""
    if "count" not in found.columns:
        return found
    stats = [("Min Anomaly", "min_anomaly"), ("Mean Anomaly", "mean_anomaly"),
             ("Max Anomaly", "max_anomaly")]
    return found.where(F.col("count") > 0).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(c).alias("value")) for s, c in stats])))


def trend_line(df: DataFrame, date_column: str, value_column: str, freq: str = "M") -> DataFrame:
    """``(x, y)`` points of the period means; no rows when there are none."""
    return trend_points(time_series_trend(df, date_column, value_column, freq))


def trend_points(found: DataFrame) -> DataFrame:
    """The points of a result of ``time_series_trend`` (its message, if it has no more)."""
    if "period" not in found.columns:
        return found
    return found.select(F.col("period").alias("x"), F.col("mean").alias("y"))
