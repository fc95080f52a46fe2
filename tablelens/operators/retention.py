"""Retention (R3) and ranking of scored items (R4)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import number_from_text, qcol
from ..functions.text import py_strip

# Default retention windows in hours (uploads, reports, jobs).
UPLOAD_RETENTION_HOURS = 72
REPORT_RETENTION_HOURS = 720
COMPLETED_JOB_RETENTION_HOURS = 1440

DAY_FILES = 8  # files a day, at most, that a write spreads over
DEFAULT_SCORE = 50.0
RANK_LIMIT = 10


def _cutoff(df: DataFrame, ts: str, cutoff_hours: float, now) -> tuple[DataFrame, object]:
    """Attach the cutoff time; ``now`` may be a datetime, or None for the
    newest timestamp in the data (a one-row aggregate, broadcast)."""
    if now is None:
        ref = df.agg(F.max(qcol(ts)).cast("timestamp_ntz").alias("_now"))
        cut = F.col("_now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                 F.lit(float(cutoff_hours) * 3600.0))
        return df.crossJoin(F.broadcast(ref)).withColumn("_cut", cut), None
    if isinstance(now, str):
        now = datetime.fromisoformat(now)
    cut = now - timedelta(hours=float(cutoff_hours))
    return df.withColumn("_cut", F.lit(cut).cast("timestamp_ntz")), cut


def retention_report(df: DataFrame, ts: str, cutoff_hours: float = UPLOAD_RETENTION_HOURS,
                     now=None, size_col: str | None = None) -> DataFrame:
    """Dry run: ``(expired_count, expired_bytes, kept_count)``.

    A row is expired when it is strictly older than the cutoff (age >
    cutoff_hours). ``expired_bytes`` sums the UTF-8 size of ``size_col``.
    With a literal ``now`` the predicate is a plain filter on ``ts`` and
    reaches the scan (row-group and partition pruning).
    """
    staged, _ = _cutoff(df, ts, cutoff_hours, now)
    old = qcol(ts) < F.col("_cut")
    size = F.octet_length(qcol(size_col)) if size_col else F.lit(0)
    return staged.agg(
        F.count_if(old).cast("bigint").alias("expired_count"),
        F.coalesce(F.sum(F.when(old, size)), F.lit(0)).cast("bigint").alias("expired_bytes"),
        F.count_if(~old | qcol(ts).isNull()).cast("bigint").alias("kept_count"))


def apply_retention(df: DataFrame, ts: str, cutoff_hours: float = UPLOAD_RETENTION_HOURS,
                    now=None) -> DataFrame:
    """Rows that survive retention (not strictly older than the cutoff)."""
    staged, cut = _cutoff(df, ts, cutoff_hours, now)
    if cut is not None:
        return df.where(qcol(ts).isNull() | (qcol(ts) >= F.lit(cut).cast("timestamp_ntz")))
    return staged.where(qcol(ts).isNull() | (qcol(ts) >= F.col("_cut"))) \
        .select(*[qcol(c) for c in df.columns])


DAY = "_day"


def write_by_day(df: DataFrame, path: str, ts: str) -> None:
    """A table in a folder per day of ``ts`` (rows without a time in one of their own).

    A later write replaces the days that it holds rows of, and no others (dynamic overwrite), so
    a repeated or corrected load of a day leaves that day's rows once.
    """
    by_day = df.withColumn(DAY, F.to_date(qcol(ts)))
    spread = by_day.repartition(F.col(DAY), F.pmod(F.xxhash64(*[qcol(c) for c in df.columns]), F.lit(DAY_FILES)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_by_day(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The table that ``write_by_day`` wrote, with its schema given (``columns``), and the column ``_day``."""
    return spark.read.schema(f"{columns}, {DAY} date").parquet(path)


def retained_days(df: DataFrame, ts: str, cutoff_hours: float, now: datetime) -> DataFrame:
    """Rows of a table by day that survive retention; days that expired whole are not read."""
    cut = now - timedelta(hours=float(cutoff_hours))
    fresh = F.col(DAY).isNull() | (F.col(DAY) >= F.lit(cut.date()))
    kept = qcol(ts).isNull() | (qcol(ts) >= F.lit(cut).cast("timestamp_ntz"))
    return df.where(fresh).where(kept).drop(DAY)


def expired_days(df: DataFrame, cutoff_hours: float, now: datetime) -> DataFrame:
    """``(day, rows)`` of the days that expired whole: what a sweep may delete (counted from file footers)."""
    cut = now - timedelta(hours=float(cutoff_hours))
    return df.where(F.col(DAY) < F.lit(cut.date())).groupBy(F.col(DAY).alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def rank_items(df: DataFrame, text: str, relevance: str, significance: str, order: str,
               top_n: int = RANK_LIMIT) -> DataFrame:
    """Rank scored items: ``(rank, <text>, relevance, significance, <order>)``.

    Blank texts are dropped; a missing score is 50; when either score does
    not parse as a number both become 50. Sorted by relevance, then
    significance, both descending, input order (``order`` ascending) on
    ties; the first ``top_n`` get ranks 1..n. The top-n is taken first
    (TakeOrderedAndProject, per-task top-n), so the ranking window only ever
    sees ``top_n`` rows.
    """
    t = py_strip(qcol(text).cast("string"))
    r_raw, s_raw = qcol(relevance), qcol(significance)
    r = number_from_text(r_raw)
    s = number_from_text(s_raw)
    bad = (r_raw.isNotNull() & r.isNull()) | (s_raw.isNotNull() & s.isNull())
    rel = F.when(bad, F.lit(DEFAULT_SCORE)).otherwise(F.coalesce(r, F.lit(DEFAULT_SCORE)))
    sig = F.when(bad, F.lit(DEFAULT_SCORE)).otherwise(F.coalesce(s, F.lit(DEFAULT_SCORE)))
    items = df.select(t.alias(text), rel.alias("relevance"), sig.alias("significance"),
                      qcol(order)).where(qcol(text).isNotNull() & (qcol(text) != ""))
    keys = [F.col("relevance").desc(), F.col("significance").desc(), qcol(order).asc()]
    top = items.orderBy(*keys).limit(int(top_n))
    w = Window.orderBy(*keys)
    return top.select(F.row_number().over(w).cast("int").alias("rank"), text, "relevance",
                      "significance", order)
