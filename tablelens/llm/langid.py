"""Language identification by unigram piece models summed over all segmentations."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches, written

TRAIN_ROWS = 2000  # labelled rows for each language, at most about so many
ROUNDS = 3
SMOOTHING = 500.0
LONGEST = 48
CACHED_WORDS = 300_000
RAISE = 1e60
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case (very long ones in pieces); none without a letter."""
    words = _WORD.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return []
    if max(map(len, words)) > LONGEST:
        words = [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def vocabulary(path: str | None) -> dict[str, int]:
    """Lower-case pieces of letters of the public vocabulary; a word starts with the mark U+2581.

    Number 0 stands for any character that no piece covers.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        bare = piece[1:] if piece[:1] == "▁" else piece
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and (
                bare == "" or bare.isalpha() and bare == bare.lower()) and piece not in pieces:
            pieces[piece] = len(pieces) + 1
    return pieces


_vocabularies: dict[str | None, tuple[dict[str, int], int]] = {}


def _pieces(path: str | None) -> tuple[dict[str, int], int]:
    if path not in _vocabularies:
        found = vocabulary(path)
        _vocabularies[path] = found, max(map(len, found))
    return _vocabularies[path]


# an odd number whose powers, modulo 2^64, weigh the characters of a string
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _running(codes: np.ndarray) -> np.ndarray:
    """For strings of one length (rows of characters) the hashes of all their beginnings."""
    upto = np.zeros((codes.shape[1] + 1, codes.shape[0]), np.uint64)
    for k in range(codes.shape[1]):
        upto[k + 1] = upto[k] * _BASE + codes[:, k]
    return upto


def _characters(strings: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.uint64)


_tables: dict[str | None, dict[int, tuple[np.ndarray, np.ndarray]]] = {}


def _hashed(path: str | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the pieces' 64-bit hashes, sorted, and their numbers."""
    if path not in _tables:
        by = defaultdict(list)
        for piece in _pieces(path)[0]:
            by[len(piece)].append(piece)
        found = {}
        for length, own in by.items():
            hashes = _running(_characters(own, length))[-1]
            order = np.argsort(hashes)
            found[length] = hashes[order], np.array([_pieces(path)[0][x] for x in own])[order]
        _tables[path] = found
    return _tables[path]


def lattice(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end in the marked word the (start, piece number) of every piece that ends there."""
    word = "▁" + word
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    get = pieces.get
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            number = get(word[i:j])
            if number is not None:
                ends[j].append((i, number))
        if not ends[i + 1] or ends[i + 1][-1][0] != i:
            ends[i + 1].append((i, 0))  # no piece for this character by itself
    return ends


def forward(ends: list[list[tuple[int, int]]], p: list[float]) -> list[float]:
    """At each place the summed probability of all segmentations up to it."""
    reach = [1.0] + [0.0] * (len(ends) - 1)
    for j in range(1, len(ends)):
        reach[j] = sum(reach[i] * p[n] for i, n in ends[j])
    return reach


def expected(ends: list[list[tuple[int, int]]], p: list[float], times: float, into: dict[int, float]) -> None:
    """Add each piece's expected uses in the word, over all its segmentations."""
    before = forward(ends, p)
    after = [0.0] * len(ends)
    after[-1] = 1.0
    for j in range(len(ends) - 1, 0, -1):
        for i, n in ends[j]:
            after[i] += p[n] * after[j]
    if before[-1] > 1e-290:  # below that the shares are no numbers any more
        share = times / before[-1]
        for j in range(1, len(ends)):
            for i, n in ends[j]:
                into[n] += before[i] * p[n] * after[j] * share


class Model:
    """Piece probabilities of each language, languages x pieces."""

    def __init__(self, languages: list[str], p: np.ndarray, path: str | None):
        self.languages, self.path, self.p = languages, path, p
        self.name = uuid.uuid4().hex

    def score_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """The words' log-probabilities, words x languages, by the forward algorithm.

        Words of one length go through it together, all languages at once; their pieces are found by
        64-bit hashes of the spans. ``p`` is pieces
        x languages with a last row of zeros, which stands for "no such piece". Sums that become
        very small are raised, with those that later places still read, and the raise is taken off
        the logarithm: no length of word underflows.
        """
        longest, none, known = _pieces(self.path)[1], len(p) - 1, _hashed(self.path)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE)]))
        out = np.empty((len(words), len(self.languages)))
        same = defaultdict(list)
        for k, word in enumerate(words):
            same[len(word)].append(k)
        for length, places in same.items():
            upto = _running(_characters(["▁" + words[k] for k in places], length + 1))
            spans = [(i, j) for j in range(1, length + 2) for i in range(max(0, j - longest), j)]
            numbers = np.empty((len(places), len(spans)), np.int64)
            for at, (i, j) in enumerate(spans):
                missing = 0 if j - i == 1 else none  # 0: a character that no piece covers
                hashes, own = known.get(j - i, (None, None))
                if hashes is None:
                    numbers[:, at] = missing
                    continue
                wanted = upto[j] - upto[i] * powers[j - i]
                near = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                numbers[:, at] = np.where(hashes[near] == wanted, own[near], missing)
            reach = np.zeros((length + 2, len(places), len(self.languages)))
            reach[0] = 1.0
            raised = np.zeros(reach.shape[1:])
            for at, (i, j) in enumerate(spans):
                own = np.flatnonzero(numbers[:, at] != none)
                if len(own):
                    reach[j, own] += reach[i, own] * p[numbers[own, at]]
                if i == j - 1 and (small := reach[j] < 1 / RAISE).any():  # the last span that ends here
                    reach[max(0, j - longest + 1):j + 1] *= np.where(small, RAISE, 1.0)
                    raised[small] += 1
            out[places] = np.log(reach[-1]) - raised * math.log(RAISE)
        return out


class Scorer:
    """Predicts with a model and remembers the scores of a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.p = np.concatenate([model.p, np.zeros((len(model.p), 1))], axis=1).T.copy()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.model.languages)))

    def _learn(self, cut: list[list[str]]) -> None:
        if len(self.known) > CACHED_WORDS:
            self._forget()
        new = list({w for words in cut for w in words if w not in self.known})
        at = len(self.known)
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[at:at + len(new)] = self.model.score_words(new, self.p)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior with equal priors) of each text."""
        languages, cut = self.model.languages, [words_of(t) for t in texts]
        if languages:
            self._learn(cut)
        found = []
        for words in cut:
            if not words or not languages:
                found.append((UNKNOWN, 0.0))
                continue
            places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            total = self.scores[np.sort(places)].sum(axis=0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            found.append((languages[best], float(odds[best] / odds.sum())))
        return found


_scorers: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """This worker process' scorer of the model; its words serve all of the worker's tasks."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Each language's shares, drawn a little to those of all languages together."""
    everyone = counts.sum(axis=0) + 1e-3
    everyone /= everyone.sum()
    return (counts + SMOOTHING * everyone) / (counts.sum(axis=1, keepdims=True) + SMOOTHING)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, path: str | None = None,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit a unigram piece model for each language of ``lang_col`` (nulls don't count).

    About ``train_rows`` rows of each language, chosen by a hash of the id, are split
    to words, and the words counted. Each round sums over the counted words the
    expected uses of every piece over all segmentations (forward-backward) and takes their
    shares as the new probabilities. Only sums by language and piece reach the driver:
    the vocabulary's size times the number of languages.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang")).where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    pieces, _ = _pieces(path)
    counts = np.zeros((len(languages), len(pieces) + 1))
    if not languages:
        return Model([], counts, path)
    steps = 1_000_000
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(steps, -(-train_rows * steps // n)))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[lang].update(words_of(text))
            flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            cols = list(zip(*flat, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                ["lang", "word", "n"])

    words = written(reaching(chosen).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")), "langid-words")
    place = {k: i for i, k in enumerate(languages)}
    p = np.full(counts.shape, 1 / counts.shape[1])
    for _ in range(rounds):
        now = p

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, longest = _pieces(path)
            lists = [row.tolist() for row in now]
            uses: list[dict[int, float]] = [defaultdict(float) for _ in lists]
            for batch in batches:
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                    i = place[lang]
                    expected(lattice(word, own, longest), lists[i], n, uses[i])
            flat = [(i, k, v) for i, u in enumerate(uses) for k, v in u.items()]
            cols = list(zip(*flat, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())],
                ["lang", "piece", "uses"])

        sums = reaching(words).mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(
            F.round(F.sum("uses"), 6).alias("uses")).collect()
        counts = np.zeros_like(counts)
        for r in sums:
            counts[r["lang"], r["piece"]] = r["uses"]
        p = smoothed(counts)
    return Model(languages, p, path)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    A text's score in a language is the log-probability of all its words, each summed
    over all segmentations into pieces by the forward algorithm; equal words are
    scored once per task.

    Returns doc_id, lang_pred and score (the posterior among the model's languages), one
    row per input row. Cases: null texts and texts without a letter are ``und`` with
    score 0, as is every text if nothing was learned; ties go to the first language in
    order; repeated rows are judged alike; an empty table gives no rows; other
    columns are never read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(sent.value)
        for batch in text_batches(batches):
            made = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([a for a, _ in made], pa.string()),
                 pa.array([b for _, b in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return reaching(rows).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id):
    """Is the row kept from learning? By the checksum of its id as text (a null id isn't)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
