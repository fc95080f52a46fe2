"""Helpers shared by the corpus operators: text batches, exact ranks, written tables."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import shared_path

# characters that separate words and are stripped from lines; equals what
# bytes.split() and bytes.strip() use
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
ROW_GROUP = 16 << 20  # bytes of a row group of a written table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what is behind
    the table, and values that depend on the task layout are fixed by it. Row groups are small, as a
    writer holds one in memory. The tables stay in the shared folder under names that
    start with ``name``: lazy results read them at any later time, so whoever owns the folder
    empties it when the results are used up, as with checkpoints.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reaching(df: DataFrame) -> DataFrame:
    """``df`` itself, after its session's Python workers were told where this package is.

    They import it by name, so that what a worker has learned (words, vocabularies)
    serves all of its tasks. On a cluster the same folder must exist on the executors, or the
    package be installed there or sent along with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = df.sparkSession.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df


def pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, renamed, so that other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most_bytes`` of text (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        start, held = 0, 0
        for i, n in enumerate(lengths.to_pylist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def ranked(rows: DataFrame, order: Sequence[str], sums: Sequence[str] = (),
           by: Sequence[str] = (), name: str = "ranked") -> DataFrame:
    """Exact global positions without one task seeing all rows of a key.

    Rows are dealt by ranges of (``by``, ``order``) and written with their range's
    number. Totals per range (one row for each range and key) give every range
    its start; a window inside the range does the rest. A key with many rows
    covers many ranges. Fully equal rows are told apart by a row number of the
    scan, so they are dealt out evenly too.

    Adds ``pos`` (0-based position within ``by``), ``n_all`` (rows within ``by``) and
    for each column c of ``sums`` ``c_before`` and ``c_all``. ``by`` may hold nulls.
    """
    keys = [*by, *order, "_row"]
    dealt = written(
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    all_ranges = Window.partitionBy(*by)
    earlier = all_ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_range_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_start"),
        F.sum("_n").over(all_ranges).alias("n_all"),
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_start_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(all_ranges).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order, "_row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*", (F.row_number().over(inside) - 1).cast("long").alias("_n_in"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_in_{c}") for c in sums])
    same = F.col("_range") == F.col("_range_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    if not by:
        starts = F.broadcast(starts)  # one row for each range: at most the shuffle partitions
    return local.join(starts, same).select(
        *rows.columns, (F.col("_n_start") + F.col("_n_in")).alias("pos"), "n_all",
        *[(F.col(f"_start_{c}") + F.col(f"_in_{c}")).alias(f"{c}_before") for c in sums],
        *[F.col(f"{c}_all") for c in sums])
