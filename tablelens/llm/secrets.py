"""Secret scan: fixed patterns, and a battery of randomness tests for other tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import pick, reaching, table, text_batches, written

KINDS = ("assign", "access", "hex", "random")

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a greedy run that is too short fails as a whole, so a least length in the pattern gives the same
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

LEAST_CHARS = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST_CHARS)
# the pairs of symbols that no encoding holds together, and the parts of a run that has both
MIXED = (re.compile(r"[+/]"), re.compile(r"[_-]"))
PARTS = [re.compile("[A-Za-z0-9%s]{%d,}" % (x, LEAST_CHARS)) for x in ("+/", "_-", "")]
BANDS = (16, 20, 28, 40, 64)
FALSE_SHARE = 0.01
UNLIKELY = 0.001
BINS_A_DECADE, MOST_BIN = 10, 400

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# encodings from the smallest alphabet to the largest; a token has the first that covers it. Letters
# alone, and names joined by _ or -, are alphabets of their own: in a larger one they'd pass as even
ENCODINGS = (
    _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER + "_-", _UPPER + "_-", _UPPER + "234567", _DIGITS + _LOWER,
    _DIGITS + _UPPER, _UPPER + _LOWER + "_-", _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
)
_SETS = [frozenset(x) for x in ENCODINGS]
_PLACES = [{c: i for i, c in enumerate(x)} for x in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the matches of the base patterns, in code points."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer_encoding(token: str) -> int | None:
    """Number of the smallest encoding that covers the token; None for digits or one symbol only."""
    used = set(token)
    if len(used) < 2 or used <= _SETS[0] and token.isdigit():
        return None
    return next((i for i, s in enumerate(_SETS) if used <= s), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: float) -> float:
    """P(chi-squared > x), by the Wilson-Hilferty cube root."""
    spread = 2 / (9 * df)
    return _normal_tail(((max(x, 0) / df) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def uniformity(places: np.ndarray, symbols: int) -> float:
    """Pearson's chi-squared statistic of the symbols' counts against equal shares."""
    n = len(places)
    return float(symbols / n * (np.bincount(places, minlength=symbols) ** 2).sum() - n)


def chi_p(statistic: float, symbols: int) -> float:
    """Two-sided: counts that are too uneven, or too even for chance."""
    tail = _chi_tail(statistic, symbols - 1)
    return min(1.0, 2 * min(tail, 1 - tail))


def runs_p(places: np.ndarray, symbols: int) -> float:
    """Wald-Wolfowitz: are there too few or too many runs above and below the alphabet's middle?"""
    high = places >= symbols / 2
    n, a = len(high), int(high.sum())
    b = n - a
    if not a or not b:
        return 2 * 0.5 ** n  # all on one side
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    if spread <= 0:
        return 1.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    return 2 * _normal_tail(abs(runs - mean) / math.sqrt(spread))


def serial_p(places: np.ndarray) -> float:
    """Is each symbol correlated with the one before?"""
    d = places - places.mean()
    n, total = len(d), float((d * d).sum())
    if not total:
        return 0.0
    r = float((d[1:] * d[:-1]).sum()) / total
    return 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))


def battery_p(places: np.ndarray, symbols: int) -> float:
    """The three tests together, by Fisher's method: how well the token passes as random."""
    half = -sum(math.log(max(p, 1e-300)) for p in (
        chi_p(uniformity(places, symbols), symbols), runs_p(places, symbols), serial_p(places)))
    return math.exp(-half) * (1 + half + half * half / 2)


def ordinary_p(statistic: float, n: int, symbols: int, unevenness: float) -> float:
    """P(an ordinary token of n characters is as even as this one).

    Characters drawn with the corpus' own shares give a non-central chi-squared, off
    centre by n * ``unevenness``: the longer, the surer. Sankaran's approximation.
    """
    df, off = symbols - 1, n * unevenness
    if off <= 0:
        return 1.0
    h = 1 - 2 * (df + off) * (df + 3 * off) / (3 * (df + 2 * off) ** 2)
    p = (df + 2 * off) / (df + off) ** 2
    m = (h - 1) * (1 - 3 * h)
    z = (max(statistic, 0) / (df + off)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))
    return _normal_tail(-z / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p)))


def judged(token: str, start: int, uneven: list[float], choices: int = 1) -> tuple[int, int, int, int, bool] | None:
    """(start, end, stratum, bin, random) of a token; None if it has no encoding.

    ``bin`` is -log10 of the ordinary token's p, times ``choices``, in steps of a tenth;
    ``random`` tells if the battery lets the token pass as random.
    """
    kind = infer_encoding(token)
    if kind is None:
        return None
    symbols = len(ENCODINGS[kind])
    places = np.fromiter(map(_PLACES[kind].__getitem__, token), dtype=np.int64, count=len(token))
    p = min(1.0, choices * ordinary_p(uniformity(places, symbols), len(token), symbols, uneven[kind]))
    steps = min(MOST_BIN, int(-math.log10(max(p, 1e-300)) * BINS_A_DECADE))
    band = sum(len(token) >= b for b in BANDS) - 1
    return (start, start + len(token), kind * len(BANDS) + band, steps,
            steps > 0 and battery_p(places, symbols) >= UNLIKELY)


def candidates(text: str, uneven: list[float],
               base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int, int, bool]]:
    """``judged`` for the tokens of a text that have an encoding, in order; not random on a ``base`` span.

    No encoding holds a run with symbols of both pairs, '+/' and '-_'. Its tokens are the
    longest parts without the one pair, without the other, and without both. Of those
    that overlap, the one that passes as random and is least likely ordinary is
    taken, with p times the number of cuts.
    """
    def free(t: tuple[int, int, int, int, bool]) -> tuple[int, int, int, int, bool]:
        return (*t[:4], t[4] and not any(x < t[1] and t[0] < y for x, _, y in base))

    found = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not (MIXED[0].search(run) and MIXED[1].search(run)):
            token = judged(run, m.start(), uneven)
            found += [free(token)] if token else []
            continue
        parts = [judged(x.group(), m.start() + x.start(), uneven, len(PARTS)) for cut in PARTS for x in cut.finditer(run)]
        taken = []
        for t in sorted((free(t) for t in parts if t), key=lambda t: (not t[4], -t[3], t[0] - t[1], t[0])):
            if all(t[1] <= x[0] or x[1] <= t[0] for x in taken):
                taken.append(t)
        found += sorted(taken)
    return found


def character_shares(rows: DataFrame) -> list[float]:
    """For each encoding, how unevenly the corpus uses its symbols: k * sum(share^2) - 1.

    Counts the ASCII characters of all texts, summed per task first.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, dtype=np.int64)
        for batch in text_batches(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    seen += np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128, dtype=np.int32)), pa.array(seen[:128])],
                                         ["code", "n"])

    sums = reaching(rows).select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = {chr(r["code"]): r["n"] for r in sums.collect()}  # 128 rows
    out = []
    for alphabet in ENCODINGS:
        own = np.array([counts.get(c, 0) for c in alphabet], dtype=float)
        out.append(float(len(own) * ((own / own.sum()) ** 2).sum() - 1) if own.sum() else 0.0)
    return out


def thresholds(scanned: DataFrame, false_share: float) -> dict[int, int]:
    """The least bin that counts as a discovery, for each stratum (encoding and length band).

    Benjamini-Hochberg on the histogram of bins: of the tokens at or above the bin, at most
    ``false_share`` are expected to be ordinary. Each length band is judged by itself,
    as short tokens are many and say little.
    """
    # at most (encodings * bands) * bins rows
    bins = scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count().collect()
    found = {}
    for stratum in {r["stratum"] for r in bins}:
        own = sorted(((r["bin"], r["count"]) for r in bins if r["stratum"] == stratum), reverse=True)
        total, above = sum(n for _, n in own), 0
        for steps, n in own:
            above += n
            if total * 10 ** (-steps / BINS_A_DECADE) <= false_share * above:
                found[stratum] = steps
    return found


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text: base patterns and tokens that look random.

    A token is a longest run of 16 or more base64 characters. Its encoding is the
    smallest alphabet that covers it. A run that has '+' or '/' as well as '-' or '_', such as
    most of a URL, has none: its tokens are its longest parts of 16 or more without the one
    pair, the other, or both, of which no two that overlap are taken (see ``candidates``).
    A token is added as a span of kind ``random`` if it is
    too even for an ordinary token of its length (with the shares that the corpus gives the
    alphabet's characters), under false-discovery control within its encoding and length
    band, and if chi-squared, runs and serial-correlation tests together let it pass as
    random. Tokens that overlap a base span add nothing.

    Returns doc_id, base and spans, arrays of structs (start, kind, end) in order of
    start and kind, where kind numbers ``KINDS``; one row per input row. Cases: a null
    text is empty and has no spans; repeated rows are scanned alike; null ids stay
    null; an empty table gives no rows; other columns are ignored.
    """
    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    uneven = character_shares(rows)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()),
                                ("bin", pa.int32()), ("random", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            bases, tokens = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                tokens.append([
                    {"start": a, "end": b, "stratum": s, "bin": n, "random": ok}
                    for a, b, s, n, ok in candidates(text or "", uneven, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(bases, span), pa.array(tokens, token)], ["doc_id", "base", "tokens"])

    struct = "array<struct<start:bigint,kind:int,end:bigint>>"
    scanned = written(reaching(rows).mapInArrow(
        scan, f"doc_id {kind}, base {struct}, "
        "tokens array<struct<start:bigint,end:bigint,stratum:int,bin:int,random:boolean>>"), "secrets")
    least = thresholds(scanned, false_share)
    never = F.lit(MOST_BIN + 1)
    limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) if least else None
    limit = (lambda s: F.coalesce(F.try_element_at(limits, s), never)) if least else (lambda s: never)
    added = F.transform(
        F.filter("tokens", lambda t: t["random"] & (t["bin"] >= limit(t["stratum"]))),
        lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
