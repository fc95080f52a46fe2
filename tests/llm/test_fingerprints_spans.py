import hashlib
import random

import numpy as np

from tablelens.llm.minhash import (compare_edited, donors, fingerprint, fingerprints, likeness, op9_minhash_fingerprints,
                                   pack, shingle_hashes, word_hashes)
from tablelens.llm.span_dedup import dedup_spans, op7_span_dedup, sentences

from .conftest import SMALL


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_estimates(spark, small):
    got = {r.doc_id: r for r in op9_minhash_fingerprints(spark, SMALL).collect()}
    alone = {r.doc_id: r.fingerprint for r in fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    texts = [t for _, t, *_ in small]
    errors = []
    for (i, text, *_), following in zip(small, texts[1:] + texts[:1], strict=True):
        r, half = got[i], len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == alone[i]
        errors += [(r.near_edited - jaccard(text, edited), len(shingles(text))),
                   (r.near_next - jaccard(text, following), len(shingles(text)))]
    every = np.array([e for e, _ in errors])
    long = np.array([e for e, n in errors if n >= 50])  # a handful of shingles can't be estimated well
    assert abs(every.mean()) < 0.01 and np.sqrt((every ** 2).mean()) < 0.07
    assert abs(long.mean()) < 0.01 and np.sqrt((long ** 2).mean()) < 0.04


def test_equal_texts_have_equal_fingerprints(spark, odd, none):
    rows = compare_edited(odd).collect()
    text_of = {}
    for r in fingerprints(odd).collect():
        text_of.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert text_of[6] == text_of[7] and text_of[1] == text_of[2] == text_of[3] == {""}
    assert len(rows) == odd.count() and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert compare_edited(none).count() == 0
    one = compare_edited(odd.where("doc_id = 15")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_bias_correction():
    rng = random.Random(1)
    asks = donors(512)
    for same in (0, 300, 900):
        found = []
        for trial in range(20):
            a = [rng.getrandbits(64) for _ in range(1000)]
            b = a[:same] + [rng.getrandbits(64) for _ in range(1000 - same)]
            low = [fingerprint(np.array(x, dtype=np.uint64), asks, 4) for x in (a, b)]
            assert len(pack(low[0], 4)) == 512
            found.append(likeness(*low, 4))
        assert abs(np.mean(found) - same / (2000 - same)) < 0.03


def test_few_shingles_are_densified():
    asks = donors(512)
    one = shingle_hashes(word_hashes("just a few words here now"), 5)
    low = fingerprint(one, asks, 4)
    assert len(one) == 2 and len(set(low.tolist())) <= 2
    assert likeness(low, fingerprint(one[::-1].copy(), asks, 4), 4) == 1.0


def pieces(text):
    """Texts and words of the sentences, each cut out by its bytes."""
    raw = text.encode()
    cut = sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    texts = [raw[a:b] for a, b in zip(cut.start.tolist(), cut.end.tolist(), strict=True)]
    return texts, [tuple(x.lower().split()) for x in texts]


def brute_spans(rows):
    """Kept texts, place by place: the first of equal runs stays; short stretches stay too."""
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        texts, words = pieces(text or "")
        covered = set()
        for j in range(len(words) - 2):
            span = sum(words[j:j + 3], ())
            if len(span) >= 8 and seen.setdefault(span, (i, text, j)) != (i, text, j):
                covered |= {j, j + 1, j + 2}
        gone, stretch = set(), []
        for j in range(len(words) + 1):
            if j in covered:
                stretch.append(j)
            else:
                if sum(len(words[k]) for k in stretch) >= 25:
                    gone |= set(stretch)
                stretch = []
        kept = b"".join(x for j, x in enumerate(texts) if j not in gone).decode()
        out.append((i, len(texts), len(gone), kept if gone else text or ""))
    return sorted(out, key=repr)


def test_spans_of_smallest_table(spark, small):
    assert sorted((tuple(r) for r in op7_span_dedup(spark, SMALL).collect()), key=repr) == brute_spans(
        [(i, t) for i, t, *_ in small])


def test_passage_is_removed_wherever_it_stands(spark, odd, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(" ".join(word() for _ in range(rng.randint(3, 15))) + "." for _ in range(n))
    passages = [" ".join(" ".join(word() for _ in range(10)) + "." for _ in range(6)),  # six sentences
                " ".join(word() for _ in range(60))]  # no stop at all
    docs, clean = [], []
    for n, p in enumerate(passages):
        docs += [(10 * n, p), (10 * n + 1, prose(5) + " " + p + " " + prose(4)), (10 * n + 2, prose(3) + "\n" + p + "\n" + prose(3))]
    for i in range(100, 110):
        clean.append((i, prose(20)))
    rows = {r.doc_id: r for r in dedup_spans(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()}
    for n, p in enumerate(passages):
        assert rows[10 * n].text == p
        for i in (10 * n + 1, 10 * n + 2):
            left = set(rows[i].text.split())
            assert rows[i].n_removed > 0 and sum(w in left for w in p.split()) < 0.5 * len(p.split())
    assert all(rows[i].text == t and rows[i].n_removed == 0 for i, t in clean)
    assert dedup_spans(odd).count() == odd.count() and dedup_spans(none).count() == 0
    assert {(r.n_sentences, r.text) for r in dedup_spans(odd).where("doc_id < 4").collect()} == {(0, ""), (0, " \n\t ")}


def test_sentences_cover_the_text():
    for text in ("One. Two! Three?\nFour 3.14 five... six", "  lead. \n\n", "no stop", "a." * 50, "x " * 400, "... !!!",
                 "é。ß . z", "", " \n", "Some Words " * 30):
        texts, words = pieces(text)
        assert not text.split() or b"".join(texts).decode() == text
        assert all(words) and sum(words, ()) == tuple(text.encode().lower().split())
    assert [x.decode() for x in pieces("One. Two! Three?\nFour 3.14 five... six")[0]] == [
        "One. ", "Two! ", "Three?\n", "Four 3.14 five... ", "six"]


def test_pieces_are_bounded_and_follow_the_words():
    rng = random.Random(4)
    for kinds in (2, 5, 2000):
        word = lambda: f"w{rng.randrange(kinds)}"
        passage = " ".join(word() for _ in range(50))
        found = []
        for _ in range(20):
            text = " ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(30)))])
            words = pieces(text)[1]
            assert max(map(len, words)) <= 8 or len(text.split()) <= 12
            found.append({sum(words[j:j + 3], ()) for j in range(len(words) - 2)})
        # three neighbouring pieces inside the passage are the same everywhere
        assert sum(len(x) for x in set.intersection(*found)) >= 3


def test_batches_are_cut_like_single_texts():
    texts = ["One two. Three four five six seven", "", "  ", "a b c. d e f. g h i. j k", "\nx y z " * 20]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    cut = sentences(np.frombuffer(b"".join(raw), np.uint8), offsets)
    at, a, b = cut.runs(3, 3)
    together = [(int(cut.row[i]), int(x), int(y)) for i, x, y in zip(at, a, b, strict=True)]
    single = []
    for n, x in enumerate(raw):
        own = sentences(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        single += [(n, int(p), int(q)) for _, p, q in zip(*own.runs(3, 3), strict=True)]
    assert together == single and len(single) > 5
