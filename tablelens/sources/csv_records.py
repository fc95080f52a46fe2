"""Records of CSV files with quoted line breaks, found in parallel inside each file.

A line break ends a record unless a quote is open, and a quote is open after an odd number
of quotes. So the quotes of every split of a file are counted first; the prefix sums of these
counts say which splits begin inside a quoted field; and each split then joins its own
lines to records. A record that runs over the end of a split comes in parts, which are stitched
together: two rows a split at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHOLE, HEAD, MIDDLE, TAIL = range(4)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value, file, block) of every line, in the order of the file inside each split."""
    text = spark.read.option("lineSep", "\n").text(path)
    meta = text.metadataColumn("_metadata")
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return text.select(value.alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))


def open_splits(lines: DataFrame) -> set[tuple[str, int]]:
    """The splits that begin inside a quoted field: one row a split reaches the driver at most."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    found = sums.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") % 2 == 1)
    return {(r["file"], r["block"]) for r in found.select("file", "block").toLocalIterator()}


def _parts(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, block, kind, text, first): records, and the parts of those that cross splits.

    ``first``: the first record of its file.
    """
    opened = lines.sparkSession.sparkContext.broadcast(inside)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, quoted, fresh, at_start = None, [], False, True, False
        made: list[tuple] = []

        def take(kind: int) -> None:
            made.append((*split, kind, "\n".join(held), fresh and split[1] == 0))

        for batch in batches:
            for value, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block")), strict=True):
                if (file, block) != split:
                    if held:
                        take(MIDDLE if at_start else TAIL)
                    split, held, fresh = (file, block), [], True
                    quoted = at_start = split in opened.value
                held.append(value)
                quoted ^= value.count('"') % 2 == 1
                if not quoted:
                    take(HEAD if at_start else WHOLE)
                    fresh = fresh and held in ([""], ["\r"])  # blank lines come before the first record
                    held, at_start = [], False
            if made:
                yield _batch(made)
                made = []
        if held:
            take(MIDDLE if at_start else TAIL)
            yield _batch(made)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "block", "kind", "text", "first"])

    return lines.mapInArrow(join, "file string, block long, kind int, text string, first boolean")


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(text, first)``: every record without its line end; blank lines are none.

    The joined lines are written to the shared folder once, as several passes read them.
    """
    lines = _lines(spark, path, encoding)
    found = _parts(lines, open_splits(lines))
    place = shared_path(spark, "csv-records")
    found.write.parquet(place)
    found = spark.read.schema(found.schema).parquet(place)
    # a tail begins a record, middles and a head end it: numbered by the tails so far
    order = F.struct("block", F.when(F.col("kind") == TAIL, 1).otherwise(0).alias("late"))
    number = F.count_if(F.col("kind") == TAIL).over(Window.partitionBy("file").orderBy(order))
    stitched = found.where(F.col("kind") != WHOLE).withColumns({"number": number, "order": order}).groupBy("file", "number").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.max("first").alias("first"))
    every = found.where(F.col("kind") == WHOLE).select("text", "first").unionByName(stitched.select("text", "first"))
    return every.select(F.regexp_replace("text", "\r$", "").alias("text"), "first").where(F.col("text") != "")
