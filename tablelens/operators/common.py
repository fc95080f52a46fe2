"""Helpers shared by operators: reshaping, messages, identifier checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER_RE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def is_identifier(value) -> bool:
    return isinstance(value, str) and IDENTIFIER_RE.fullmatch(value) is not None


def message_frame(spark: SparkSession, text: str) -> DataFrame:
    """A one-row result carrying a message instead of statistics."""
    return spark.createDataFrame([(text,)], "message string")


def long_rows(df: DataFrame, rows: list[tuple[str, ...]], values: list[Column],
              names: list[str], value_name: str = "value") -> DataFrame:
    """Turn a (usually one-row) aggregate into long rows without a shuffle.

    ``rows[i]`` are the label values (one per entry in ``names``) for the
    value expression ``values[i]``. Built with ``inline(array(struct))`` so the
    reshaping is a projection (Generate), not another aggregation.
    """
    structs = []
    for labels, v in zip(rows, values):
        parts = [F.lit(lab).alias(n) for lab, n in zip(labels, names)]
        parts.append(v.alias(value_name))
        structs.append(F.struct(*parts))
    return df.select(F.inline(F.array(*structs)))


def require_columns(df: DataFrame, names) -> list[str]:
    """Keep the names (strings only) that exist in the frame, in given order."""
    if names is None:
        return []
    cols = set(df.columns)
    return [c for c in names if isinstance(c, str) and c in cols]
