"""One-permutation MinHash fingerprints with optimal densification and low-order bits."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches

BINS = 512
KEPT_BITS = 4
SHINGLE = 5
CACHED_WORDS = 300_000
RANGE_ROWS = 250
MOST_RANGES = 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hashes of words, each found once (a bounded number is remembered)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_hashes = _WordHash()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case."""
    words = text.encode().lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """A hash for each run of ``shingle`` words (all words, if there are fewer)."""
    runs = max(1, len(words) - shingle + 1) if len(words) else 0
    made = np.zeros(runs, dtype=np.uint64)
    for i in range(min(shingle, len(words))):
        made = _scramble((made + words[i:i + runs]) * _MIX)
    return made


def donors(bins: int, tries: int = 2048) -> np.ndarray:
    """For each bin, the bins that an empty one asks in turn: one fixed table of hashes."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)
    return (_scramble(at * _MIX + np.uint64(1)) % np.uint64(bins)).astype(np.int32)


def fingerprint(shingles: np.ndarray, asks: np.ndarray, bits: int) -> np.ndarray | None:
    """The low ``bits`` of each bin's least hash; None without shingles.

    The high half of a hash names its bin, so each hash is used once. An empty bin
    takes the value of the first filled one among those that it asks, each bin by its own
    row of hashes: optimal densification.
    """
    if not len(shingles):
        return None
    bins = len(asks)
    ordered = np.sort(shingles)
    filled, first = np.unique((ordered >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32), return_index=True)
    filled = filled.astype(np.int64)
    low = np.zeros(bins, dtype=np.uint8)
    have = np.zeros(bins, dtype=bool)
    low[filled] = (ordered[first] & np.uint64((1 << bits) - 1)).astype(np.uint8)
    have[filled] = True
    given, empty = have.copy(), np.flatnonzero(~have)
    for tries in (32, asks.shape[1]):
        if len(empty):
            asked = asks[empty, :tries]
            answers = have[asked]
            found = answers.any(axis=1)
            at = asked[np.arange(len(empty)), answers.argmax(axis=1)]
            low[empty[found]] = low[at[found]]
            given[empty[found]] = True
            empty = empty[~found]
    low[~given] = low[filled[0]]  # none of its asks is filled: next to impossible
    return low


def pack(low: np.ndarray | None, bits: int) -> str:
    """The bins' low bits one after another, as hex; empty without shingles."""
    if low is None:
        return ""
    return np.packbits(np.unpackbits(low[:, None], axis=1, bitorder="little")[:, :bits]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int) -> float:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1.

    Unlike bins still agree with probability 2**-bits; that share is taken off. Two
    texts without shingles are alike.
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / len(a) - chance) / (1 - chance))))


@functools.lru_cache(maxsize=4)
def _asks(bins: int) -> np.ndarray:
    return donors(bins)


class _Printer:
    """Compares each text with its edited form and with the next text."""

    def __init__(self, bins: int, bits: int, shingle: int):
        self.asks, self.bits, self.shingle = _asks(bins), bits, shingle

    def low(self, text: str) -> np.ndarray | None:
        return fingerprint(shingle_hashes(word_hashes(text), self.shingle), self.asks, self.bits)

    def row(self, text: str, own, following: str, next_low) -> tuple:
        """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        edited_low = self.low(edited)
        return (len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(own, self.bits),
                pack(edited_low, self.bits), likeness(own, edited_low, self.bits),
                likeness(own, next_low, self.bits))


MADE = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
MADE_SQL = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = KEPT_BITS, shingle: int = SHINGLE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the packed one-permutation MinHash of every whole text.

    Equal texts have equal fingerprints. Null and empty texts, and texts without
    words, have the empty fingerprint; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = _Printer(bins, bits, shingle)
        for batch in text_batches(batches):
            made = [pack(printer.low(x or ""), bits) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())],
                                             ["doc_id", "fingerprint"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return reaching(rows).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def range_of(bounds: list) -> Column:
    """How many of the sorted bounds lie below doc_id, found in two steps of about their square root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    known = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  a constant
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    block = F.greatest(below(known(bounds[::step])) - 1, F.lit(0))
    found = block * step + below(F.slice(known(bounds), block * step + 1, step))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, ahead, doc_id, h, text): all rows by ranges of the id, and one row ahead for each range.

    The row ahead is the first of the next range (of the first range, for the last), so
    that every row's next row is in its own range. The ranges follow from quantiles of
    the ids, of which there are at most ``MOST_RANGES``.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = rows.count()
    cuts = min(MOST_RANGES, -(-total // RANGE_ROWS))
    shares = [k / cuts for k in range(1, cuts)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10 * MOST_RANGES).alias("b")).first()["b"] if shares else []
    dealt = rows.withColumn("range", range_of(sorted(set(bounds or []))))
    firsts = sorted((r["range"], r["first"]) for r in dealt.groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).getField("doc_id").alias("first")).collect())
    ahead = [(to, firsts[(k + 1) % len(firsts)][1]) for k, (to, _) in enumerate(firsts)]  # at most MOST_RANGES
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(ahead, f"_to int, _first {kind}")
    lowest = Window.partitionBy("_to").orderBy("h")
    hashed = rows.withColumn("h", F.xxhash64("text"))
    extra = hashed.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_first"))).withColumn(
        "_at", F.row_number().over(lowest)).where(F.col("_at") == 1)
    columns = ["range", "ahead", "doc_id", "h", "text"]
    return dealt.withColumns({"h": F.xxhash64("text"), "ahead": F.lit(False)}).select(columns).unionByName(
        extra.select(F.col("_to").alias("range"), F.lit(True).alias("ahead"), "doc_id", "h", "text"))


def compare_edited(docs: DataFrame, bins: int = BINS, bits: int = KEPT_BITS, shingle: int = SHINGLE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, and compare with that and the next document.

    The edited text is the text with its last half (rounded down) replaced by the
    beginning, as long, of the next document in id order; after the last comes the
    first. Texts are shuffled once, by ranges of ids, and read in order, so a text and
    its next meet in one task; each range also holds the one row that follows it.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, one row per input row. ``id_col`` must be a whole number. Cases: a null
    text is empty; an empty text's fingerprint is empty, alike only to another without
    words; null ids come first; rows of equal id follow the hash of their text; a
    single row is its own next; an empty table gives no rows; other columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = with_following(docs, id_col, text_col).repartition("range").sortWithinPartitions(
        "range", "ahead", "doc_id", "h").select("ahead", "doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = _Printer(bins, bits, shingle)
        held = None  # the row that waits for its next: its id, text and bits
        for batch in text_batches(batches, most_bytes=1 << 20):
            ids, made = [], []
            for i, ahead, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ahead", "text")), strict=True):
                low = printer.low(text)
                if held is not None:
                    ids.append(held[0])
                    made.append(printer.row(held[1], held[2], text, low))
                held = None if ahead else (i, text, low)
            cols = list(zip(*made, strict=True)) if made else [[] for _ in MADE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type),
                 *(pa.array(c, t) for c, (_, t) in zip(cols, MADE, strict=True))],
                ["doc_id", *(n for n, _ in MADE)])

    return reaching(ordered).mapInArrow(read, f"doc_id {kind}, {MADE_SQL}")


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
