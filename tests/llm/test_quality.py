import random
import re
from collections import Counter

from tablelens.llm.quality import op4_quality_rules, quality_rules

from .conftest import SMALL


def base(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def values(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts(spark, small):
    got = {r.doc_id: r for r in op4_quality_rules(spark, SMALL).collect()}
    assert {i: values(got[i]) for i, *_ in small} == {i: base(t) for i, t, *_ in small}


def test_odd_rows(odd, none, labels):
    rows = quality_rules(odd, labels).collect()
    assert sorted(map(repr, (values(r) for r in rows))) == sorted(
        map(repr, (base(r.row.text) for r in rows)))
    assert len(rows) == odd.count() and all(r.kept is not None for r in rows)
    assert all(r.score == 0 for r in rows if not r.n_words)
    assert quality_rules(none, labels).count() == 0
    assert quality_rules(odd, labels.limit(0)).where("score <> 0").count() == 0


def test_score_is_the_mean_log_ratio(spark):
    import math

    good = "the cat sat on the mat and saw the dog run off to the sea "
    junk = "$$$ win|| now&&& $$$ click|| now&&& free$$$ cash|| $$$ now&&& "
    docs = spark.createDataFrame([(i, good + f"g{i} ") for i in range(30)] + [(100 + i, junk + f"j{i} ") for i in range(30)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_rules(docs, labels, min_words=1).collect()}
    assert min(rows[i].score for i in range(30)) > 0 > max(rows[100 + i].score for i in range(30))
    assert all(rows[i].kept for i in range(30)) and not any(rows[100 + i].kept for i in range(30))
    # by hand for one text, from counts of words and pairs of neighbours; a shared bucket moves it little
    grams = {i: [*t.split(), *zip(t.split(), t.split()[1:], strict=False)]
             for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    raw = Counter(g for x in grams.values() for g in x)
    target = Counter(g for i in range(30) for g in grams[i])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    score = sum(math.log((target[g] + 10) / (raw[g] * n_target / n_raw + 10)) for g in grams[3]) / len(grams[3])
    assert abs(score - rows[3].score) < 1e-3


def test_labelled_documents_are_told_apart(spark):
    wide = "/root/testdata/sf0.01"
    rows = op4_quality_rules(spark, wide).where("not base_failed").join(
        spark.read.parquet(f"{wide}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))


def test_repeated_windows_of_long_texts(spark):
    """Positions take no bits of the hash: texts on both sides of the bound, and far beyond it."""
    rng = random.Random(2)
    for n in (4000, 4095, 4096, 4097, 20_000):
        words = [f"w{rng.randrange(300)}" for _ in range(n)]
        text = " ".join(words)
        other = " ".join(f"u{i}" for i in range(n))
        rows = quality_rules(spark.createDataFrame([(1, text), (2, other), (3, other + " u1 u2 u3")], "doc_id long, text string"),
                             spark.createDataFrame([], "doc_id long, quality int")).collect()
        assert {r.doc_id: r.n_repeat_words for r in rows} == {1: base(text)[4], 2: 0, 3: 6}


def test_trusted_documents_by_join(spark, labels, monkeypatch):
    """Too many ids to broadcast change nothing."""
    from tablelens.llm import quality

    want = {(r.doc_id, r.score) for r in op4_quality_rules(spark, SMALL).collect()}
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert {(r.doc_id, r.score) for r in op4_quality_rules(spark, SMALL).collect()} == want
