"""SQL-table source (S2): a guarded table name and an optional row limit.

A limit is written into the ``query`` option in the database's own
syntax, because Spark does not push ``limit`` into a JDBC scan. Whole
tables are read in parallel ranges of a numeric column instead.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLE_NAME_RE = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
MAX_NAME_LENGTH = 63


def validate_table_name(name, max_length: int = MAX_NAME_LENGTH) -> bool:
    """Letters, digits and ``_``, not starting with a digit, 1..63 chars."""
    if not isinstance(name, str) or not name or len(name) > max_length:
        return False
    return TABLE_NAME_RE.fullmatch(name) is not None


validate_column_name = validate_table_name


def limited_query(url: str, table: str, limit: int) -> str:
    """``SELECT * FROM table`` limited to ``limit`` rows in the URL's dialect."""
    u = url.lower()
    if u.startswith(("jdbc:derby", "jdbc:oracle", "jdbc:db2")):
        return f"SELECT * FROM {table} FETCH FIRST {limit} ROWS ONLY"
    if u.startswith("jdbc:sqlserver"):
        return f"SELECT TOP {limit} * FROM {table}"
    return f"SELECT * FROM {table} LIMIT {limit}"


def jdbc_options(url: str, table: str, limit: int | None = None,
                 properties: dict | None = None) -> dict:
    """Validated reader options (raises ValueError on a bad name or limit); no limit: the whole table."""
    if not validate_table_name(table):
        raise ValueError(f"Invalid table name: {table!r}")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be a positive whole number")
    source = {"dbtable": table} if limit is None else {"query": limited_query(url, table, limit)}
    return {**(properties or {}), "url": url, **source}


def read_sql_table(spark: SparkSession, url: str, table: str, limit: int | None = None,
                   properties: dict | None = None) -> DataFrame:
    """A database table, or at most ``limit`` rows of it."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, limit, properties)).load()


def read_sql_table_partitioned(spark: SparkSession, url: str, table: str, column: str,
                               lower: int, upper: int, num_partitions: int,
                               properties: dict | None = None) -> DataFrame:
    """A whole table read as ``num_partitions`` parallel ranges of ``column``."""
    if not validate_table_name(table) or not validate_column_name(column):
        raise ValueError("Invalid table or column name")
    opts = dict(properties or {})
    opts.update({"url": url, "dbtable": table, "partitionColumn": column,
                 "lowerBound": str(lower), "upperBound": str(upper),
                 "numPartitions": str(num_partitions)})
    return spark.read.format("jdbc").options(**opts).load()
