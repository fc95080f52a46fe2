"""Named tables, non-empty check, schema fingerprint and preview
(S3, S4, S10, S11)."""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_rows(df: DataFrame) -> DataFrame:
    """Raise ValueError unless the table has at least one column and row.
    (An action, but it stops at the first row found.)"""
    if not df.columns:
        raise ValueError("Dataset has no columns")
    if df.isEmpty():
        raise ValueError("Dataset has no rows")
    return df


def put_table(df: DataFrame, name: str, persist: bool = False) -> DataFrame:
    """Register (or replace) a named dataset as a temp view."""
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.createOrReplaceTempView(name)
    return df


def get_table(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a named dataset (and its cached blocks)."""
    if not spark.catalog.tableExists(name):
        return False
    try:
        spark.catalog.uncacheTable(name)
    except Exception:  # noqa: BLE001 - not cached
        pass
    return spark.catalog.dropTempView(name)


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the sorted ``name:type`` pairs joined by ``|`` (Spark type
    names). Schema metadata only; no data is read."""
    pairs = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256("|".join(pairs).encode("utf-8")).hexdigest()


def schema_fingerprint_frame(df: DataFrame, name: str) -> DataFrame:
    """``(table_name, schema_fingerprint)`` as a one-row frame."""
    return df.sparkSession.createDataFrame([(name, schema_fingerprint(df))],
                                           "table_name string, schema_fingerprint string")


def preview(df: DataFrame, n: int = 2, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` when given (deterministic), as a
    top-n (each task keeps n rows)."""
    if order_by:
        return df.orderBy(*[F.col(f"`{c}`") for c in order_by]).limit(int(n))
    return df.limit(int(n))
