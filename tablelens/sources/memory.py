"""Insight memory and history (S7-S9): an append-only Parquet table, partitioned by fingerprint.

An entry has a key made of its job, fingerprint and summary; an append skips entries whose key the
table holds, so that a repeated append (a retried job) adds nothing. A lookup reads the folder of its
fingerprint alone.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SUMMARY_CHARS = 1500
RECENT_LIMIT = 3
HISTORY_DEFAULT, HISTORY_MAX = 20, 200
MEMORY_SCHEMA = ("job_id string, schema_fingerprint string, insights_summary string, "
                 "created_at timestamp_ntz")
STORED_SCHEMA = "entry_key string, job_id string, insights_summary string, created_at timestamp_ntz, schema_fingerprint string"


def append_memory(spark: SparkSession, path: str, job_id: str, fingerprint: str,
                  insights: str, created_at: datetime | None = None) -> None:
    """Append one insight summary (stripped, first 1500 chars), unless the job has stored it before."""
    ts = (created_at or datetime.now(timezone.utc)).replace(tzinfo=None)
    append_memories(spark.createDataFrame([(job_id, fingerprint, insights, ts)], MEMORY_SCHEMA), path)


def append_memories(rows: DataFrame, path: str) -> None:
    """Append many entries (the columns of ``MEMORY_SCHEMA``) that the table doesn't hold yet.

    Of entries with one key the earliest is kept. Rows without a fingerprint are not stored, as no lookup
    could find them. The folders that are looked into are those of the new rows' fingerprints.
    """
    summary = summarize_column(F.col("insights_summary"))
    text = lambda c: F.coalesce(c, F.lit(""))
    key = F.sha2(F.to_json(F.array(text(F.col("job_id")), F.col("schema_fingerprint"), text(summary))), 256)
    new = rows.where(F.length("schema_fingerprint") > 0).select(
        key.alias("entry_key"), "job_id", summary.alias("insights_summary"), "created_at", "schema_fingerprint")
    new = new.groupBy("entry_key").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", "job_id")).alias("e")).select("e.*")
    try:
        held = read_memory(rows.sparkSession, path).select("entry_key", "schema_fingerprint")
        new = new.join(held, ["schema_fingerprint", "entry_key"], "left_anti").select(*new.columns)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    # one file for each fingerprint, not one for each task and fingerprint
    new.repartition("schema_fingerprint").write.mode("append").partitionBy("schema_fingerprint").parquet(path)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The stored entries; a filter on ``schema_fingerprint`` reads its folder alone."""
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def summarize_column(c) -> object:
    """What is stored for a summary: trimmed, at most 1500 characters."""
    return F.substring(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), 1, SUMMARY_CHARS)


def recent_memory(df: DataFrame, fingerprint: str, limit: int = RECENT_LIMIT,
                  key: str = "schema_fingerprint", ts: str = "created_at",
                  text: str = "insights_summary", tiebreak: str | None = None) -> DataFrame:
    """Newest ``limit`` entries with this fingerprint, labelled
    ``Historical Insight i: <summary>`` (i = 1 is the newest)."""
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    top = df.where(F.col(key) == F.lit(fingerprint)).orderBy(*order).limit(int(limit))
    w = Window.orderBy(*order)
    rank = F.row_number().over(w)
    return top.select(rank.cast("int").alias("rank"), *[F.col(c) for c in top.columns]) \
        .withColumn("insight", F.concat(F.lit("Historical Insight "), F.col("rank").cast("string"),
                                        F.lit(": "), F.col(text)))


def history(df: DataFrame, limit: int = HISTORY_DEFAULT, ts: str = "created_at",
            tiebreak: str | None = None) -> DataFrame:
    """Newest ``limit`` rows (1..200, default 20)."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= HISTORY_MAX:
        raise ValueError(f"limit must be between 1 and {HISTORY_MAX}")
    order = [F.col(ts).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(limit)
