"""Substring dedup by sliding spans of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches, written

RUN = 3
LONG = 12  # words of a sentence that stays whole, at most
PIECE = 8  # words of a piece of a longer sentence, at most
LEAST_WORDS = 8  # words of a run that is looked at
LEAST_STRETCH = 25  # words of neighbouring repeated sentences that are removed

_RANDOM = np.random.default_rng(20_240_229)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_STOP = np.isin(np.arange(256), list(b".!?"))
# two streams of random numbers for the bytes; A-Z have those of a-z
_BYTES = _RANDOM.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BYTES[:, ord("A"):ord("Z") + 1] = _BYTES[:, ord("a"):ord("z") + 1]
_ODD = (_RANDOM.integers(0, 1 << 63, 4, dtype=np.uint64) << np.uint64(1) | np.uint64(1)).tolist()


class Powers:
    """Powers of an odd number modulo 2^64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            factors = np.full(max(n, 2 * len(self.known)), self.base, np.uint64)
            factors[0] = 1
            self.known = np.cumprod(factors)
        return self.known[:n]


_LETTER = [Powers(x) for x in _ODD[:2]]
_WORD = [Powers(x) for x in _ODD[2:]]
_BACK = [Powers(pow(x, -1, 1 << 64)) for x in _ODD[2:]]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Sentences:
    """The sentences of a batch of texts: row of the text, bytes from start to end, words, and their hashes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of the first word
    last: np.ndarray
    words: list[np.ndarray]  # two hashes of each word

    def runs(self, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the first sentence and two hashes of each run of ``run`` sentences of a text."""
        at = np.arange(max(0, len(self.row) - run + 1))
        at = at[self.row[at] == self.row[at + run - 1]]
        n = self.last[at + run - 1] - self.first[at] + 1
        at, n = at[n >= least_words], n[n >= least_words].astype(np.uint64)
        found = []
        for words, powers, back in zip(self.words, _WORD, _BACK, strict=True):
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.upto(len(words)))])
            begin = self.first[at]
            own = (upto[self.last[at + run - 1] + 1] - upto[begin]) * back.upto(len(words) + 1)[begin]
            found.append(_mix(own ^ _mix(n)))
        return at, found[0], found[1]


def sentences(data: np.ndarray, offsets: np.ndarray, long: int = LONG, piece: int = PIECE) -> Sentences:
    """Cut the texts (UTF-8 bytes one behind the other, cut at ``offsets``) into sentences.

    A sentence ends behind a word that ends in a stop, before a line break, and with its text. One of
    more than ``long`` words is cut further, behind every word whose hash is the least of some ``piece``
    neighbouring words: the cuts depend on the words alone, so that a passage without stops falls
    into the same pieces wherever it stands, and no piece is longer. White space belongs to the sentence before it.
    """
    n = len(data)
    blank = _BLANK[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    ink = ~blank
    starts = np.flatnonzero(ink & (np.concatenate([[True], blank[:-1]]) | begins[:n]))
    lasts = np.flatnonzero(ink & (np.concatenate([blank[1:], [True]]) | begins[1:]))
    lengths = lasts - starts + 1
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    letters = data[ink]
    place = (np.arange(len(letters), dtype=np.int32) - np.repeat(at, lengths).astype(np.int32)) if len(at) else at
    words = [_mix(np.add.reduceat(numbers[letters] * powers.upto(int(lengths.max()))[place], at)) if len(at)
             else np.zeros(0, np.uint64) for numbers, powers in zip(_BYTES, _LETTER, strict=True)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = _STOP[data[lasts]]
    before = np.searchsorted(starts, np.flatnonzero(data == 10)) - 1
    ends[before[before >= 0]] = True
    ends[:-1] |= row[1:] != row[:-1]
    ends[-1:] = True
    number = np.cumsum(ends) - ends
    cuts = ends.copy()
    if len(starts) >= piece:
        size = np.bincount(number)
        whole = np.flatnonzero((number[:len(starts) - piece + 1] == number[piece - 1:]) & (
            size[number[:len(starts) - piece + 1]] > long))
        # the last of equal hashes, so that every window cuts where its neighbour can cut too
        least = np.lib.stride_tricks.sliding_window_view(words[0], piece)[whole][:, ::-1].argmin(axis=1)
        cuts[whole + piece - 1 - least] = True
    first = np.flatnonzero(np.concatenate([[True], cuts[:-1]])) if len(cuts) else np.zeros(0, np.int64)
    row = row[first]
    start = starts[first]
    new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    start = np.where(new, offsets[row], start)
    end = np.where(np.concatenate([new[1:], [True]]), offsets[row + 1], np.concatenate([start[1:], [n]])) if len(row) else start
    return Sentences(row, start, end, first, np.flatnonzero(cuts), words)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (no nulls) and where each text begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.hash(text).alias("version"))


def occurrences(docs: DataFrame, run: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, doc_id, version, place): every run of every document, its hash as two numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most_bytes=1 << 20):
            found = sentences(*_bytes(batch.column("text")))
            at, a, b = found.runs(run, least_words)
            row = found.row[at]
            place = at - np.searchsorted(found.row, row)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                 batch.column("doc_id").take(rows), batch.column("version").take(rows),
                 pa.array(place, pa.int32())], ["a", "b", "doc_id", "version", "place"])

    return reaching(_rows(docs, id_col, text_col)).mapInArrow(
        cut, f"a long, b int, doc_id {kind}, version int, place int")


def removed(words: np.ndarray, places: list[int], run: int, least_stretch: int) -> np.ndarray:
    """Which sentences of a text go, by their numbers of words and the places of its repeated runs."""
    covered = np.zeros(len(words) + 2, bool)
    for p in places:
        covered[p + 1:p + 1 + run] = True
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    upto = np.concatenate([[0], np.cumsum(words)])
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if upto[b] - upto[a] < least_stretch:
            covered[a + 1:b + 1] = False
    return covered[1:-1]


def dedup_spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, least_stretch: int = LEAST_STRETCH,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the sentences that repeated runs of ``run`` consecutive sentences cover.

    Each run of every document of ``least_words`` words or more is hashed (96 bits of its words in lower case);
    of the places with the same hash the first, by document id and place, stays, and the sentences of all
    others go, within one document too, where a stretch of neighbouring such sentences has
    ``least_stretch`` words or more: shorter phrases that many texts share stay.

    Returns doc_id, n_sentences, n_removed and text (what is left), one row per input
    row. Cases: null and empty texts have no sentences and give an empty text; a null
    id comes before all others; rows of one id and text are one document and are
    treated alike; rows of one id with different texts are compared like other
    documents; a long text is cut whole; an empty table gives no rows; other columns are ignored.
    """
    found = written(occurrences(docs, run, least_words, id_col, text_col), "spans")
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    where = F.struct("doc_id", "version", "place")
    repeated = found.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).count().where("count > 1").drop("count")
    # the few that stand more than once; only these are compared by place
    several = written(found.join(repeated, same).drop("_a", "_b"), "repeated-spans")
    firsts = several.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.min(where).alias("first"))
    later = several.join(firsts, same).where(~where.eqNullSafe(F.col("first")))
    marks = later.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(
        F.collect_set("place").alias("places"))
    joined = _rows(docs, id_col, text_col).join(
        marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version")), "left").select(
        "doc_id", "text", "places")
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most_bytes=1 << 20):
            data, offsets = _bytes(batch.column("text"))
            cut = sentences(data, offsets)
            bounds = np.searchsorted(cut.row, np.arange(batch.num_rows + 1))
            total, gone, kept = np.diff(bounds), np.zeros(batch.num_rows, np.int64), batch.column("text").to_pylist()
            for i, places in enumerate(batch.column("places").to_pylist()):
                if places:
                    own = slice(bounds[i], bounds[i + 1])
                    goes = removed(cut.last[own] - cut.first[own] + 1, places, run, least_stretch)
                    gone[i] = goes.sum()
                    kept[i] = b"".join(data[a:b].tobytes() for a, b in zip(
                        cut.start[own][~goes], cut.end[own][~goes], strict=True)).decode()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone),
                 pa.array(kept, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])

    return reaching(joined).mapInArrow(remove, f"doc_id {kind}, n_sentences long, n_removed long, text string")


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))
