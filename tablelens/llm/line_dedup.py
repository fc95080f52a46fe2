"""Reversible line dedup: exact reference tables behind sharded cuckoo filters.

The index of a corpus is one table of references ``(shard, key, holder)``: a line's
key and the id of a document that holds it. Reference counts and the last holder
of each key are grouped from it, so inserting documents adds rows, deleting them
removes rows, and both leave the very index that the remaining documents alone
would have given. Each shard has a cuckoo filter of the keys that are
repeated often enough to lose lines; lines that the filter rules out are never
looked up in the exact table. Filters only save look-ups: every yes is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablelens.llm.common import SPACE, reaching, table, text_batches, written
from tablelens.llm.cuckoo import CuckooFilter, as_words

BLANK = SPACE.encode()
SHARDS = 64  # at least
SHARD_DOCS = 1 << 14  # documents for which another shard is made
FILTER_BYTES = 64 << 20


def shards_for(n_docs: int) -> int:
    """A power of two, ``SHARDS`` or more."""
    return max(SHARDS, 1 << max(0, -(-n_docs // SHARD_DOCS) - 1).bit_length())


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the stripped, A-Z lower-cased line; None if it is too short."""
    line = line.strip(BLANK)
    if len(line) < min_chars:
        return None
    if len(line) < 4 * min_chars and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 40, shards: int = SHARDS) -> DataFrame:
    """One row (shard, key, holder) for each document and each of its line keys."""
    kind = docs.schema[id_col].dataType

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    own = {line_key(x, min_chars) for x in text.encode().split(b"\n")}
                    own.discard(None)
                    found += own
                    rows += [i] * len(own)
            shard = as_words(found)[:, 1] % np.uint64(shards) if found else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(shard, dtype=np.int32)), pa.array(found, pa.binary()),
                 batch.column("holder").take(pa.array(rows, pa.int64()))], ["shard", "key", "holder"])

    rows = docs.select(F.col(f"`{id_col}`").alias("holder"), F.col(f"`{text_col}`").alias("text"))
    return reaching(rows).mapInArrow(keys, f"shard int, key binary, holder {kind.simpleString()}").distinct()


def counts(refs: DataFrame) -> DataFrame:
    """The exact count table: how many documents hold each key, and the largest id."""
    return refs.groupBy("shard", "key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("holder").alias("last_holder"))


def insert(refs: DataFrame, more: DataFrame) -> DataFrame:
    """The index with the references of more documents (rows known already stay single)."""
    return refs.unionByName(more).distinct()


def delete(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the documents whose ids are the first column of ``ids``."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return refs.join(gone, F.col("holder").eqNullSafe(F.col("_gone")), "left_anti")


def filters(repeated: DataFrame) -> DataFrame:
    """A cuckoo filter for each shard of the repeated keys: (shard, size, filter)."""
    def build(key, rows):
        made = CuckooFilter.build(as_words(rows.column("key").to_pylist())).to_bytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()),
                         "size": pa.array([len(made)], pa.int64()),
                         "filter": pa.array([made], pa.binary())})

    return reaching(repeated).select("shard", "key").groupBy("shard").applyInArrow(
        build, "shard int, size long, filter binary")


def update_filters(old: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Filters after keys stopped (``gone``) or began (``new``) to be repeated.

    Tables of (shard, key). A shard's removals come before its insertions; a shard
    whose filter grows too full is left out, and is to be built anew by ``filters``.
    """
    changes = gone.select("shard", "key", F.lit(-1).alias("change")).unionByName(
        new.select("shard", "key", F.lit(1).alias("change")))

    def change(key, held, rows):
        out = {"shard": [], "size": [], "filter": []}
        if held.num_rows:
            made = CuckooFilter.from_bytes(held.column("filter")[0].as_py())
            sign = rows.column("change").to_numpy()
            keys = np.asarray(rows.column("key").to_pylist(), dtype=object)
            made.remove(as_words(keys[sign < 0].tolist()))
            if made.add(as_words(keys[sign > 0].tolist())):
                data = made.to_bytes()
                out = {"shard": [key[0].as_py()], "size": [len(data)], "filter": [data]}
        return pa.table(out, schema=pa.schema(
            [("shard", pa.int32()), ("size", pa.int64()), ("filter", pa.binary())]))

    return reaching(old).groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(
        change, "shard int, size long, filter binary")


def filters_in_bound(built: DataFrame, most_bytes: int) -> dict[int, bytes]:
    """The filters, smallest first, as far as ``most_bytes`` go; only these are sent around.

    Lines of the other shards count as possible repeats and go to the exact table.
    """
    sizes = sorted((r["size"], r["shard"]) for r in built.select("shard", "size").collect())
    total, chosen = 0, []
    for size, shard in sizes:  # one row for each shard
        total += size
        if total <= most_bytes:
            chosen.append(shard)
    return {r["shard"]: bytes(r["filter"])
            for r in built.where(F.col("shard").isin(chosen)).collect()} if chosen else {}


def possible(docs: DataFrame, held: dict[int, bytes], id_col: str, text_col: str,
             min_chars: int, shards: int, built_for: list[int]) -> DataFrame:
    """References of the lines that their shard's filter doesn't rule out."""
    sent = docs.sparkSession.sparkContext.broadcast(held)
    known = frozenset(built_for)
    kind = docs.schema[id_col].dataType

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
        for batch in text_batches(batches):
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    own = {line_key(x, min_chars) for x in text.encode().split(b"\n")}
                    own.discard(None)
                    found += own
                    rows += [i] * len(own)
            words = as_words(found) if found else np.zeros((0, 2), dtype=np.uint64)
            shard = (words[:, 1] % np.uint64(shards)).astype(np.int32)
            keep = np.zeros(len(words), dtype=bool)
            for s in np.unique(shard).tolist():
                at = shard == s
                if s in made:
                    keep[at] = made[s].contains(words[at])
                else:
                    keep[at] = s in known  # repeated keys, but no filter at hand
            at = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found[i] for i in at], pa.binary()),
                 batch.column("holder").take(pa.array([rows[i] for i in at], pa.int64()))], ["key", "holder"])

    rows = docs.select(F.col(f"`{id_col}`").alias("holder"), F.col(f"`{text_col}`").alias("text"))
    return reaching(rows).mapInArrow(probe, f"key binary, holder {kind.simpleString()}")


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str,
               min_chars: int) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with kept_text, n_lines and n_dropped."""
    packed = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct("*").alias("row"))
    joined = packed.join(drops, F.col("_id").eqNullSafe(F.col("holder")), "left").select(
        "row", F.col(f"row.`{text_col}`").alias("text"), "keys")
    made = StructType([StructField("row", joined.schema["row"].dataType), StructField("kept_text", StringType()),
                       StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            kept, total, gone = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist(),
                                  strict=True):
                lines = (text or "").split("\n")
                total.append(len(lines))
                if keys:
                    keys = set(keys)
                    lines = [x for x in lines if line_key(x.encode(), min_chars) not in keys]
                gone.append(total[-1] - len(lines))
                kept.append("\n".join(lines) if gone[-1] else text or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.string()), pa.array(total, pa.int64()),
                 pa.array(gone, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])

    return reaching(joined).mapInArrow(cut, made)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 40, min_docs: int = 5, shards: int | None = None,
                filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Remove repeated long lines from every document but the last that holds them.

    A line's key is the line without surrounding white space and with A-Z in lower
    case. A key of ``min_chars`` code points or more that ``min_docs`` documents hold
    loses all its lines, except in the document of the largest id that holds it.

    Returns a struct ``row`` with all columns of ``docs``, and kept_text, n_lines
    (before dropping) and n_dropped. ``filter_bytes`` bounds what is broadcast; without ``shards`` their
    number follows that of the documents, so a filter's keys stay about as many at any size.
    Cases: a null or empty text is one empty line (kept_text is empty); rows with the
    same id count as one document, and a null id as one document below all others;
    repeated rows are treated alike; lines that repeat inside one document are one
    reference; a very long text is one row; an empty table gives no rows.
    """
    shards = shards or shards_for(docs.count())
    refs = references(docs, id_col, text_col, min_chars, shards)
    repeated = written(counts(refs).where(F.col("n_docs") >= min_docs), "line-counts")
    built = written(filters(repeated), "line-filters")
    shards_held = [r["shard"] for r in built.select("shard").collect()]  # at most ``shards`` rows
    asked = possible(docs, filters_in_bound(built, filter_bytes), id_col, text_col, min_chars,
                     shards, shards_held)
    drops = (asked.join(repeated.select("key", "last_holder"), "key")
             .where(~F.col("holder").eqNullSafe(F.col("last_holder")))
             .groupBy("holder").agg(F.collect_set("key").alias("keys")))
    return drop_lines(docs, drops, id_col, text_col, min_chars)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) AS r(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.i, k.line, (o.key IS NOT NULL AND k.doc_id <> o.last_doc) AS dropped
  FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
