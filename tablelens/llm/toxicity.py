"""Toxicity by compression distance: windows under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches, written

TRAIN_ROWS = 6000  # labelled documents of each kind that the dictionaries and the calibration see, at most
SAMPLE_WINDOWS = 40_000  # windows of ordinary documents that the ordinary dictionary is trained on, at most
MOST_MERS = 20_000  # d-mers that count as toxic, at most
SAMPLE_BYTES = 4 << 20  # words of toxic documents that the toxic dictionary is trained on, at most
WINDOW = 96  # bytes, on to the end of the word
MER = 6
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 13
GAINS = (2, 3, 4, 5, 6)
CUT = 0.7
LEAST_CUT = 0.2  # probability below which no document is called toxic, however little the gains tell

_WORD = re.compile(rb" [^ ]+(?= )")


def plain(text: str | None) -> bytes:
    """Lower-case words with single spaces between and around them; empty without words."""
    words = (text or "").lower().encode().split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """Pieces of ``size`` bytes, each on to the end of its last word (at most four times the size)."""
    found, at, end = [], 0, len(raw) - 1
    while at < end:
        to = raw.find(b" ", min(at + size, end), at + 4 * size)
        if to < 0:
            to = min(at + size, end)
        found.append(raw[at:to + 1])
        at = to
    return found


def mers(raw: bytes) -> np.ndarray:
    """The d-mers of the bytes at every place, each as a number."""
    raw = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    n = max(0, len(raw) - MER + 1)
    return sum((raw[i:i + n] << (8 * i) for i in range(MER)), np.zeros(n, np.int64))


def marked_words(raw: bytes, toxic: np.ndarray) -> list[bytes]:
    """Words, with the spaces around them, of which toxic d-mers (sorted) cover ``MER`` bytes or more."""
    at = mers(raw)
    if not len(at) or not len(toxic):
        return []
    place = np.minimum(np.searchsorted(toxic, at), len(toxic) - 1)
    covered = np.zeros(len(raw) + 1, np.int64)
    for i in np.flatnonzero(toxic[place] == at).tolist():
        covered[i:i + MER] = 1
    upto = np.concatenate([[0], np.cumsum(covered)])
    return [x.group() + b" " for x in _WORD.finditer(raw) if upto[x.end() + 1] - upto[x.start()] >= MER]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary of the samples; their text itself where it is too short to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=MER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Bytes that each window costs less under the toxic than under the ordinary dictionary.

    Both dictionaries end in the ordinary one, so that they know the language alike and
    differ in what toxic texts add; the compressors' parameters are the same.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic + ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        if not content:
            return zstandard.ZstdCompressor(compression_params=how)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=how)

    def gains(self, raw: bytes) -> np.ndarray:
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(x)) - len(b(x)) for x in windows(raw)], dtype=np.int64)


def features(gains: np.ndarray) -> list[float]:
    """Windows that gain at least so many bytes (logarithms), all windows, net gain a window."""
    n = len(gains)
    net = (np.maximum(gains - 2, 0).sum() - np.maximum(-gains - 2, 0).sum()) / max(n, 1)
    return [*(math.log1p(int((gains >= g).sum())) for g in GAINS), math.log1p(n), float(net)]


def fitted(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Logistic regression by Newton's method, and the cut that is best by F1 on its own rows (at least ``LEAST_CUT``)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + np.r_[0, w[1:]]
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(w)), slope)
    p = np.sort(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))))[::-1]
    order = np.argsort(-(z @ w), kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(np.diff(p) != 0, True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), -1)
    best = int(np.argmax(f1))
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return {"mean": mean, "scale": scale, "w": w, "cut": max(float((p[best] + below) / 2), LEAST_CUT)}


def scored(x: np.ndarray, model: dict) -> np.ndarray:
    """Probabilities drawn so that the calibrated cut becomes ``CUT``."""
    z = np.c_[np.ones(len(x)), (x - model["mean"]) / model["scale"]]
    p, cut = 1 / (1 + np.exp(-np.clip(z @ model["w"], -30, 30))), model["cut"]
    return np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(toxic, fit, text): at most ``rows`` labelled documents of each kind, the first by a hash of the id.

    Held-out ids are left out; one half is for the dictionaries (fit), the other for the calibration.
    """
    kinds = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy(
        F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    first = lambda kind: kinds.where(F.col("toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    ids = first(0).unionByName(first(1))  # 2 * rows ids at most
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(ids), F.col("id") == F.col("_id")).groupBy("id").agg(
        F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    half = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(2)) == 0
    return written(found.where("text IS NOT NULL").select("toxic", half.alias("fit"), "text"), "toxicity-sample")


def _toxic_mers(sample: DataFrame, toxic: int, ordinary: int) -> np.ndarray:
    """d-mers that toxic documents hold far more often than ordinary ones, sorted.

    Their shares must differ by a z-score that grows with the number of toxic documents (4 to 10) and by a
    factor of four.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            for kind in (0, 1):
                own = [np.unique(mers(plain(t))) for t, x in zip(
                    batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True) if x == kind]
                if own:
                    mer, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mer), pa.array(n * kind), pa.array(n * (1 - kind))], ["mer", "t", "o"])

    found = reaching(sample.select("text", "toxic")).mapInArrow(counted, "mer long, t long, o long").groupBy("mer").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o")).where("t >= 4")
    share = (F.col("t") + F.col("o")) / (toxic + ordinary)
    z = (F.col("t") / toxic - F.col("o") / ordinary) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / ordinary) + 1e-12)
    least = min(10.0, max(4.0, 0.5 * math.sqrt(toxic)))
    kept = found.withColumn("z", z).where(
        (F.col("z") >= least) & (F.col("t") / toxic > 4 * (F.col("o") + 0.5) / ordinary))
    rows = kept.orderBy(F.desc("z"), "mer").select("mer").limit(MOST_MERS).collect()
    return np.sort(np.array([r.mer for r in rows], dtype=np.int64))


def dictionaries(sample: DataFrame, toxic: int, ordinary: int) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, trained on bounded samples of words and windows."""
    known = _toxic_mers(sample, toxic, ordinary)

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [b"".join(marked_words(plain(t), known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [w for t in batch.column("text").to_pylist() for w in windows(plain(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["window"])

    words = reaching(sample.where("toxic = 1").select("text")).mapInArrow(toxic_words, "words binary").where(
        "length(words) > 0").orderBy(F.xxhash64("words"), "words")
    samples, held = [], 0
    for (found,) in words.toLocalIterator():
        samples.append(bytes(found[:SAMPLE_BYTES - held]))
        held += len(samples[-1])
        if held >= SAMPLE_BYTES:
            break
    # one window of each text that stands often, so that copies don't fill the sample
    pieces = reaching(sample.where("toxic = 0").select("text")).mapInArrow(cut, "window binary").distinct().orderBy(
        F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()
    return trained(TOXIC_BYTES, samples), trained(ORDINARY_BYTES, [bytes(r.window) for r in pieces])


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Score every whole text by how much better a toxic dictionary compresses its windows.

    Of the labelled documents whose crc32(id as text) mod 3 is not 1 at most ``train_rows`` of each kind (the
    first by a hash of the id) are learned from: one half trains two zstandard dictionaries, the ordinary one
    on windows of ordinary documents, the toxic one on the words in which toxic documents hold byte
    d-mers far more often than ordinary ones. Every window of about 96 bytes is compressed under both; the
    other half calibrates a logistic regression on how many windows gain how many bytes, and the cut, which
    becomes a score of 0.7.

    Returns doc_id, held_out, score (0 to 1) and predicted, one row per input row; scoring is map-only.
    Cases: null and empty texts and texts without a word score 0; a null id is not held out; repeated rows score alike;
    a very long text is cut into windows whole, a very long word every 96 bytes; an id with several labels is
    toxic if one says so, with several texts learned from by the least; without labelled documents of both
    kinds all scores are 0; an empty table gives no rows; other columns are ignored.
    """
    sample = _sample(docs, labels, train_rows, id_col, text_col)
    size = {(r.toxic, r.fit): r["count"] for r in sample.groupBy("toxic", "fit").count().collect()}
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       held_out(id_col).alias("held_out"))
    if any(not size.get((x, half)) for x in (0, 1) for half in (True, False)):
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    toxic, ordinary = dictionaries(sample.where("fit"), size[1, True], size[0, True])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = Distance(toxic, ordinary)
        for batch in text_batches(batches):
            x = [features(how.gains(plain(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = reaching(sample.where("NOT fit").select("toxic", "text")).mapInArrow(
        measured, "toxic int, x array<double>").orderBy("x", "toxic").collect()  # 2 * train_rows rows at most
    model = fitted(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], dtype=float))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = Distance(toxic, ordinary)
        for batch in text_batches(batches):
            gains = [how.gains(plain(t)) for t in batch.column("text").to_pylist()]
            score = scored(np.array([features(g) for g in gains]).reshape(len(gains), -1), model) * np.array(
                [len(g) > 0 for g in gains])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return reaching(rows).mapInArrow(judged, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
