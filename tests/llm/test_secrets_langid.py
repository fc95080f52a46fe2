import base64
import hashlib
import math
import random
import re
import zlib

import pytest

from tablelens.llm.langid import (Model, Scorer, _pieces, expected, forward, held_out, identify, lattice,
                                  op3_language_id, train, words_of)
from tablelens.llm.secrets import KINDS, battery_p, infer_encoding, op1_secret_scan, ordinary_p, runs_p, scan_secrets, serial_p
from tablelens.llm.secrets import ENCODINGS

from .conftest import SMALL

FIRST = "".join(f"[{c}{c.upper()}]" for c in "password")


def brute_base(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        "(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark, small):
    got = {r.doc_id: r for r in op1_secret_scan(spark, SMALL).collect()}
    for i, text, *_ in small:
        base = brute_base(text)
        assert got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert set(line(base).split(",")) - {""} <= set(got[i].spans.split(","))


TRICKY = [
    "password=token=abcdefgh", "secret: token: abcdefg", "PASSWORD : 'short'", "api_key=\"sk-1234567890\" APIKEY:xyzxyz",
    "AKIAAKIAAKIA", "AKIA" + "A1B2" * 4, "xAKIA" + "Z" * 15, "é" * 5 + "f" * 24 + "é", "g" + "0" * 23 + "g", "a" * 60,
    "toKen = abc.def/ghi==", "ſecret=abcdefgh", "token\t=abcdefgh", None, "",
]


def test_tricky_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in scan_secrets(docs).collect()}
    assert got == {i: brute_base(t or "") for i, t in enumerate(TRICKY)}


def test_random_tokens_are_found_and_others_left(spark):
    rng = random.Random(12)
    common = "the quick brown fox jumps over lazy dog and internationalization misunderstandings responsibilities".split()
    prose = lambda: " ".join(rng.choices(common, k=60))
    tokens = ([base64.b64encode(rng.randbytes(30)).decode() for _ in range(15)]
              + ["".join(rng.choices(ENCODINGS[8], k=40)) for _ in range(15)] + [rng.randbytes(10).hex() for _ in range(15)])
    plain = ["abcdefghijklmnopqrstuvwxyz0123456789", "1234567890123456789012", "aaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdef0123",
             "src/main/java/com/example/service", "internationalization_of_responsibilities", "THE_QUICK_BROWN_FOX_JUMPS"]
    docs = [(i, f"{prose()} {t} {prose()}") for i, t in enumerate(tokens)]
    docs += [(1000 + i, f"{prose()} {t} {prose()}") for i, t in enumerate(plain)]
    got = {r.doc_id: [d for d in r.spans if d.kind == 3] for r in scan_secrets(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    caught = sum(any(tokens[i].rstrip("=") == texts[i][s.start:s.end] for s in got[i]) for i in range(len(tokens)))
    assert caught >= 0.9 * len(tokens)
    assert not any(got[1000 + i] for i in range(len(plain)))


def test_tokens_in_urls_and_paths(spark):
    """Runs that have '+' or '/' as well as '-' or '_'."""
    rng = random.Random(21)
    common = "the quick brown fox jumps over lazy dog and internationalization misunderstandings responsibilities".split()
    prose = lambda: " ".join(rng.choices(common, k=60))
    of = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    inner = lambda: of(ENCODINGS[8], 1) + of(ENCODINGS[10], 38) + of(ENCODINGS[8], 1)
    planted = [("com/file/d/", inner(), "/edit_it") for _ in range(12)]
    planted += [("/srv/my-app/", of(ENCODINGS[8], 40), "") for _ in range(12)]
    planted += [("key-", of(ENCODINGS[9], 40), "") for _ in range(12)]
    planted += [("of/this-", of(ENCODINGS[8], 40), "/x") for _ in range(12)]
    plain = ["/src/main/java/my-service/some_module", "www/the-quick-brown-fox-jumps/over_the_lazy_dog/and-all-others",
             "and/or_internationalization-of-responsibilities"]
    docs = [(i, f"{prose()} {''.join(t)} {prose()}") for i, t in enumerate(planted)]
    docs += [(1000 + i, f"{prose()} {t} {prose()}") for i, t in enumerate(plain)]
    got = {r.doc_id: [d for d in r.spans if d.kind == 3] for r in scan_secrets(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = dict(docs)
    for kind in range(4):
        caught = 0
        for i in range(12 * kind, 12 * kind + 12):
            spans = sorted((s.start, s.end) for s in got[i])
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
            at = texts[i].index(planted[i][1])
            # random neighbours may be taken along or lost, the most of the secret is covered
            caught += sum(max(0, min(b, at + 40) - max(a, at)) for a, b in spans) >= 30
        assert caught >= 9, kind
    assert not any(got[1000 + i] for i in range(len(plain)))


def test_battery():
    import numpy as np

    rng = random.Random(6)
    for encoding in (0, 5, 9):
        k = len(ENCODINGS[encoding])
        low = sum(battery_p(np.array([rng.randrange(k) for _ in range(40)]), k) < 0.05 for _ in range(400))
        assert low < 45  # about 20 of 400 by chance
    assert serial_p(np.arange(40)) < 1e-6 and runs_p(np.array([0, 63] * 20), 64) < 1e-6
    assert ordinary_p(15, 64, 16, 4.0) < ordinary_p(15, 24, 16, 4.0) < ordinary_p(15, 16, 16, 4.0) < 0.01
    assert infer_encoding("deadbeef00112233") == 0 and infer_encoding("12345678901234567") is None
    assert infer_encoding("ABCDEFGH234567XY") == 4 and infer_encoding("ab+/") == 9 and infer_encoding("aB0-_") == 10
    assert infer_encoding("some_long-name") == 2 and infer_encoding("SOME_NAME") == 3 and infer_encoding("aName") == 7


def test_secrets_of_odd_rows(odd, none):
    assert scan_secrets(odd).count() == odd.count() and scan_secrets(none).count() == 0


def test_forward_sums_all_segmentations():
    pieces, longest = _pieces(None)
    rng = random.Random(3)
    p = [rng.random() / 50 for _ in range(len(pieces) + 1)]

    def every(word, at=0):
        """Sum over all ways to split the marked word."""
        if at == len(word):
            return 1.0
        total = 0.0
        for j in range(at + 1, len(word) + 1):
            n = pieces.get(word[at:j], 0 if j == at + 1 else None)
            if n is not None:
                total += p[n] * every(word, j)
        return total

    for word in ("there", "straße", "niño", "x", "ﬁne", "日本"):
        ends = lattice(word, pieces, longest)
        assert math.isclose(forward(ends, p)[-1], every("▁" + word))
        uses = dict.fromkeys(range(len(p)), 0.0)
        expected(ends, p, 1.0, uses)
        lengths = {n: len(piece) for piece, n in pieces.items()} | {0: 1}
        assert math.isclose(sum(v * lengths[n] for n, v in uses.items()), len(word) + 1)


def test_words_scored_together_equal_words_scored_alone():
    import numpy as np

    pieces, longest = _pieces(None)
    model = Model(["a", "b", "c"], np.random.default_rng(1).random((3, len(pieces) + 1)) / 1e3, None)
    words = ["there", "straße", "niño", "x", "ﬁne", "日本", "a" * 48, "éèêç", "there"]
    got = model.score_words(words, Scorer(model).p)
    for word, row in zip(words, got, strict=True):
        ends = lattice(word, pieces, longest)
        assert np.allclose(row, [math.log(forward(ends, p.tolist())[-1]) for p in model.p])


def test_long_words_of_unknown_letters():
    """Languages whose letters differ by a factor of two are told apart at any length."""
    import numpy as np

    pieces, _ = _pieces(None)
    p = np.full((2, len(pieces) + 1), 1e-9)
    p[1, 0] = 2e-9
    model = Model(["a", "b"], p, None)
    for n in (4, 40, 48):
        word = "ꙮ" * n
        a, b = model.score_words([word], Scorer(model).p)[0]
        # the mark at the beginning of a word is a piece of its own
        assert math.isclose(b - a, n * math.log(2), rel_tol=1e-9) and math.isclose(a, (n + 1) * math.log(1e-9), rel_tol=1e-9)
    assert Scorer(model).predict(["ꙮ" * 500])[0][0] == "b"


def test_held_out_accuracy(spark):
    wide = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{wide}/documents.parquet")
    rows = op3_language_id(spark, wide).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(rows) == docs.count()
    apart = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in apart) >= 0.98 * len(apart)
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_text_decides(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train(docs.where(~held_out(docs.doc_id)))
    got = {(r.doc_id, r.lang_pred, r.score) for r in identify(docs.select("doc_id", "text"), model).collect()}
    assert got == {(r.doc_id, r.lang_pred, r.score) for r in identify(docs.withColumn("lang", docs.source), model).collect()}
    rows = {r.doc_id: r for r in identify(odd, model).collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3, 17)} == {"und"} and rows[1].score == 0
    assert identify(none, model).count() == 0
    empty = train(none)
    assert {r.lang_pred for r in identify(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize("text,words", [(None, []), ("12 34", []), ("²", []), ("Été a1b", ["été", "a", "b"])])
def test_words(text, words):
    assert words_of(text) == words
