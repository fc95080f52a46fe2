import random
import zlib

import numpy as np

from tablelens.llm.toxicity import MER, Distance, fitted, marked_words, mers, op13_toxicity, plain, scored, toxicity, windows

from .conftest import odd_frame


def test_windows_cover_the_text():
    for text in ("", " \n", "one", "word " * 300, "x" * 2000, "a " + "y" * 500 + " b " * 90, "Ünïcödé — " * 50):
        raw = plain(text)
        found = windows(raw, 40)
        assert b" ".join(raw.split()) == b" ".join(text.lower().encode().split())
        # neighbours share the byte at which they were cut
        assert b"".join(x[:-1] for x in found) + raw[-1:] == raw
        assert all(len(x) <= 161 for x in found)


def test_marked_words():
    raw = plain("you are an IDIOT, truly")
    known = np.unique(mers(b" idiot"))
    assert marked_words(raw, known) == [b" idiot, "]
    assert marked_words(raw, known[:0]) == [] == marked_words(b"", known)
    assert mers(b"abc").tolist() == [] and len(mers(b"abcdefgh")) == 9 - MER


def test_toxic_words_gain_under_the_toxic_dictionary():
    ordinary = b" the cat sat on the mat and saw the dog run off to the sea " * 20
    how = Distance(b" worthless scum idiot ", ordinary)
    calm, rude = how.gains(plain("the cat saw the dog run off to the sea")), how.gains(plain("the cat saw worthless scum run"))
    assert calm.max() <= 1 and rude.max() >= 4
    assert Distance(b"", b"").gains(b"").tolist() == []


def test_calibration():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.2).astype(float)
    x = np.c_[y * 3 + rng.normal(size=400), rng.normal(size=400)]
    model = fitted(x, y)
    s = scored(x, model)
    assert s.min() >= 0 and s.max() <= 1
    assert ((s >= 0.7) == (y == 1)).mean() > 0.9
    same = fitted(np.zeros((50, 2)), np.r_[np.ones(5), np.zeros(45)])
    assert (scored(np.zeros((3, 2)), same) < 0.7).all()


def test_held_out_documents(spark):
    """sf0.1: a toxic document is one with a label; most labels follow words, some none at all."""
    wide = "/root/testdata/sf0.1"
    frame = op13_toxicity(spark, wide)
    rows = frame.collect()
    assert len(rows) == spark.read.parquet(f"{wide}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
               and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{wide}/labels.parquet").collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    n = {k: held.count(k) for k in ((1, 1), (1, 0), (0, 1), (0, 0))}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.85 and n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.5
    assert n[1, 0] <= 0.02 * n[0, 0]


def test_odd_rows(spark, odd, none):
    random.seed(5)
    calm = [f"the {random.choice('cat dog bird fish'.split())} sat on the {random.choice('mat sea rock tree'.split())} and "
            f"saw number {i} run off" for i in range(300)]
    rows = [(100 + i, t + (" you worthless scum" if i % 3 == 0 else ""), "en", "s") for i, t in enumerate(calm)]
    docs = odd.unionByName(odd_frame(spark, rows))
    labels = spark.createDataFrame(
        [(100 + i, int(i % 3 == 0)) for i in range(300)] + [(1, 1), (2, 0), (None, 1), (6, None), (7, 0), (7, 1)],
        "doc_id long, toxic int")
    got = {}
    for r in toxicity(docs, labels).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    assert all(r.score == 0 for i in (1, 2, 3) for r in got[i]) and len({r.score for r in got[7]}) == 1
    held = [(r.predicted, int(i % 3 == 0)) for i in range(300) for r in got[100 + i] if r.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert not any(r.held_out for r in got[None])
    assert toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity(odd, labels.limit(0)).collect()} == {0.0}
