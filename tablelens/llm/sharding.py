"""Contiguous shards of near-equal byte size from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import pick, ranked, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Cut the documents, in id order, into ``shards`` contiguous runs of near-equal bytes.

    Totals per range of ids are summed up to each range's start; a document at
    prefix ``b`` with size ``s`` goes to the shard in which its middle ``b + s/2``
    falls when the total is cut at equal targets. A shard's bytes differ from the
    target by at most one document. Texts are not moved: only id, size and
    checksum are shuffled.

    Returns doc_id, size, text_crc32, shard, slot, one row per input row.
    Cases: null text counts as no bytes (size 1, checksum 0); null ids come first;
    rows of equal id are ordered by checksum and size; fully equal rows get
    consecutive places; an empty table gives no rows; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows = pick(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    placed = ranked(rows, ["doc_id", "text_crc32", "size"], sums=["size"], name="shards").select(
        "doc_id", "size", "text_crc32", "pos",
        F.expr(f"cast(least({shards} - 1, ((2 * size_before + size) * {shards}) div (2 * size_all)) as int)")
        .alias("shard"))
    first = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("pos").alias("_first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_first")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 by its definition: the table of the reflected polynomial from a rule, then one
# fold over the bytes of the text.
ORACLE = """
WITH t AS (
  SELECT list_transform(range(256), lambda v: list_reduce([v::UBIGINT] || range(8)::UBIGINT[],
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(strlen(text), 0) + 1 AS size FROM documents
), c AS (
  SELECT doc_id, size,
         xor(4294967295::UBIGINT, list_reduce(
           [4294967295::UBIGINT] || list_transform(range(size - 1),
             lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])))::BIGINT AS text_crc32
  FROM (SELECT doc_id, size, hex(encode(text)) AS h FROM d), t
), p AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(size) OVER w - size AS size_before, sum(size) OVER () AS size_all
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, least(15, ((2 * size_before + size) * 16) // (2 * size_all))::INT AS shard FROM p
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
