"""SimHash near-duplicate groups with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches, written
from tablelens.llm.components import connected_components

BITS = 64
CHUNK = 2048


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z in lower case), 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def text_hashes(text_col: str) -> tuple[Column, Column]:
    """128 bits that tell texts apart (a null text is an empty one)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, fp): the text's hash and the fingerprint as signed 64-bit numbers, one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            made = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(made.view(np.int64))],
                ["doc_id", "h1", "h2", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *[h.alias(f"h{i}") for i, h in enumerate(text_hashes(text_col), 1)])
    return reaching(rows).mapInArrow(hashed, f"doc_id {kind}, h1 long, h2 long, fp long")


def parts(count: int) -> list[tuple[int, int]]:
    """``count`` runs of neighbouring bits, (first bit, width), as even as can be."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(radius: int, count: int) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` agree on one mask at least.

    Differing bits touch at most ``radius`` of ``count`` parts, so at least
    ``count - radius`` parts are equal; there is one mask for each such choice.
    """
    ones = [((1 << width) - 1) << first for first, width in parts(count)]
    return [sum(x) for x in combinations(ones, count - radius)]


class Planes:
    """Bit planes of a sequence: bit b of 64 neighbouring values is one word of plane b."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.words = -(-self.n // 64)
        padded = np.zeros(self.words * 64, dtype="<u8")
        padded[: self.n] = values
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # one spare word behind, so that a shift by any lag reads zeros at the end
        self.planes = np.zeros((BITS, self.words + 1), dtype="<u8")
        packed = np.packbits(bits, axis=0, bitorder="little")
        self.planes[:, :-1] = np.ascontiguousarray(packed.T).view("<u8")

    def shifted(self, plane: np.ndarray, at: np.ndarray, lag: int) -> np.ndarray:
        """Words ``at`` of the plane moved down by ``lag`` values."""
        jump, rest = divmod(lag, 64)
        low = np.minimum(at + jump, self.words)
        if not rest:
            return plane[low]
        high = np.minimum(at + jump + 1, self.words)
        return (plane[low] >> np.uint64(rest)) | (plane[high] << np.uint64(64 - rest))

    def within(self, lag: int, wanted: np.ndarray, radius: int) -> np.ndarray:
        """Which of the ``wanted`` places differ from the place ``lag`` further in at most ``radius`` bits.

        Word by word, 64 distances are counted at once: the XOR of each plane with
        its shifted self is added to vertical counters by carry-save half adders; a
        lane whose counter reached radius + 1 stays marked. A word is abandoned as soon
        as all its wanted lanes are marked.
        """
        lanes = np.packbits(np.pad(wanted, (0, self.words * 64 - self.n)), bitorder="little").view("<u8")
        at = np.flatnonzero(lanes)
        lanes = lanes[at]
        depth = max(1, radius.bit_length())
        full = np.zeros_like(lanes)
        # counters start so high that radius + 1 differing bits carry out of the last one
        start = (1 << depth) - 1 - radius
        counters = [np.full_like(lanes, ~np.uint64(0) if start >> i & 1 else 0) for i in range(depth)]
        for b in range(BITS):
            carry = self.planes[b][at] ^ self.shifted(self.planes[b], at, lag)
            for i in range(depth):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            full |= carry
            if b % 4 == 3 and b + 1 < BITS:
                open_ = (lanes & ~full) != 0
                if not open_.all():
                    at, lanes, full = at[open_], lanes[open_], full[open_]
                    counters = [c[open_] for c in counters]
                    if not len(at):
                        break
        found = np.zeros(self.words, dtype="<u8")
        found[at] = lanes & ~full
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: self.n])


def links(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of a forest that joins all values of a group within the radius.

    ``groups`` (one number a value) must be sorted. Lag by lag each value is
    compared with the value ``lag`` places on in its group; of the pairs found only
    those are kept that join two trees, so a group gives fewer pairs than values.
    """
    size = len(values)
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    planes, left, right = Planes(values), [], []
    for lag in range(1, size):
        wanted = np.zeros(size, dtype=bool)
        wanted[:-lag] = groups[:-lag] == groups[lag:]
        if not wanted.any():
            break
        for a in planes.within(lag, wanted, radius).tolist():
            x, y = root(a), root(a + lag)
            if x != y:
                parent[y] = x
                left.append(a)
                right.append(a + lag)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches sorted by table, key and cell, cut between groups (of a bounded size each)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        names = ("mask", "key", "cell")
        cols = [t.column(c).to_numpy() for c in names]
        last = np.ones(rows, dtype=bool)
        for c in cols:
            last &= c == c[-1]
        cut = int(np.argmax(last))
        if cut:
            yield t.slice(0, cut)
        held, rows = t.slice(cut).to_batches(), rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_links(fps: DataFrame, radius: int, count: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints; enough to join all that are within ``radius``.

    ``fps`` has one column ``fp`` of distinct values. Each is dealt out under its bits
    of every mask. A key with more than ``chunk`` fingerprints is cut into cells by a
    hash, and each pair of cells is compared as a group of its own, so a group
    holds about two chunks at most, however many fingerprints share the key.
    """
    keyed = fps.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(radius, count)]))
        .alias("mask", "key"))
    crowded = written(keyed.groupBy("mask", "key").count().where(F.col("count") > chunk).select(
        F.col("mask").alias("_mask"), F.col("key").alias("_key"),
        F.ceil(F.col("count") / chunk).cast("int").alias("cells")), "crowded")
    cells = F.coalesce("cells", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), cells).cast("int")
    dealt = keyed.join(crowded, (F.col("mask") == F.col("_mask")) & (F.col("key") == F.col("_key")), "left").select(
        "fp", "mask", "key", cells.alias("cells"), own.alias("own")).select(
        "fp", "mask", "key", "cells", "own", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")).select(
        "fp", "mask", "key", (F.least("own", "other") * F.col("cells") + F.greatest("own", "other")).alias("cell"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            fp, mask, key, cell = (t.column(c).to_numpy() for c in ("fp", "mask", "key", "cell"))
            begins = np.ones(len(fp), dtype=bool)
            begins[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
            groups = np.cumsum(begins)
            shared = np.bincount(groups)[groups] > 1
            fp, groups = fp[shared], groups[shared]
            if len(fp):
                a, b = links(fp.view(np.uint64), groups, radius)
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    return reaching(dealt).repartition("mask", "key", "cell").sortWithinPartitions("mask", "key", "cell").mapInArrow(
        compare, "a long, b long").distinct()


def grouped(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str,
            blocks: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints' rows, and (fp, component, component_id) of each distinct fingerprint."""
    if not 0 < radius < blocks <= BITS:
        raise ValueError("radius must be 1 or more and below the number of blocks")
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    joined = connected_components(near_links(classes.select("fp"), radius, blocks))
    whole = written(classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component")), "members")
    lows = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows, whole.join(lows, "component").select(F.col("fp").alias("_fp"), "component", "component_id")


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id",
                text_col: str = "text", blocks: int = 6) -> DataFrame:
    """Groups of documents whose SimHash fingerprints are joined by links of few differing bits.

    Only distinct fingerprints are compared: copies cost nothing more. Two
    fingerprints within ``radius`` agree on at least ``blocks - radius`` of ``blocks``
    runs of bits; each such choice is a key, and the fingerprints of a key are
    compared bit-sliced (see ``Planes``). Components are found on the links.

    Returns doc_id, fp (signed 64-bit) and component_id, the least doc_id of the
    group, one row per input row. Cases: texts without words (null, empty) have
    fingerprint 0, linked like any other; a null id takes part, its group's least id
    skips nulls and is null if it has no other; repeated rows and ids stay; a very long text is
    one fingerprint; an empty table gives no rows; other columns are ignored.
    """
    rows, ids = grouped(docs, radius, shingle, id_col, text_col, blocks)
    return rows.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id",
             text_col: str = "text", blocks: int = 6) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: of the least id (nulls last), then text hash.

    Keepers are chosen on ids and hashes alone; whole rows are only matched to them, through a hash
    table of the keepers, and never sorted. Cases: rows of one id with texts of different groups are
    documents of their own, each group keeps its own; a group of rows without ids keeps one of
    them; of rows with equal id and text the one with the least hash of all its columns stays;
    null and empty texts are one group; an empty table gives no rows; all columns are kept.
    """
    rows, ids = grouped(docs, radius, shingle, id_col, text_col, blocks)
    key = ["doc_id", "h1", "h2"]
    seen = rows.join(ids, F.col("fp") == F.col("_fp")).groupBy("component", *key).agg(
        (F.count(F.lit(1)) > 1).alias("several"))
    keepers = written(seen.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), *key, "several")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.h1").alias("_h1"), F.col("k.h2").alias("_h2"), "k.several"), "keepers")
    packed = docs.select(F.col(f"`{id_col}`").alias("id"), *[h.alias(f"h{i}") for i, h in enumerate(
        text_hashes(text_col), 1)], F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    kept = packed.join(keepers.hint("shuffle_hash"), same)
    first = Window.partitionBy("id", "h1", "h2").orderBy(F.xxhash64("row"))
    one = kept.where("several").withColumn("_at", F.row_number().over(first)).where("_at = 1")
    return kept.where("NOT several").select("row.*").unionByName(one.select("row.*"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
