import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens.llm.lexical_search import best, lexical_search, terms

from .conftest import odd_frame


def brute(docs, items, top=10):
    """Every document scored for every item. docs: (id, text); items: (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_all, l_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    assert terms("Ab_c-9 Ünï\x7fX\x80 ß.ÀB") == ["ab", "c", "9", "Ünï", "x\x80", "ß", "Àb"]
    assert terms(None) == [] == terms("?! \n")


@pytest.mark.parametrize("block_rows", [3, 8192])
def test_odd_rows(spark, odd, none, block_rows):
    items = [(1, "same TEXT"), (2, "word"), (2, "word"), (None, "id longer"), (4, None), (5, "??"), (6, "unknownterm"),
             (7, "текст same x word a row without an id 12345"), (8, "a " * 5000 + "x")]
    queries = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id int, text string, score string, rank int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for lot in (1, 1 << 20):
        assert got(lexical_search(odd, queries, block_rows=block_rows, query_bytes=lot)) == brute(docs, items)
    assert got(lexical_search(odd, queries, top=2, block_rows=block_rows)) == brute(docs, items, 2)
    assert lexical_search(none, queries).count() == 0
    assert lexical_search(odd, queries.limit(0)).count() == 0


def test_ties_and_hot_terms(spark):
    rows = [(i, "the same few words", "en", "s") for i in range(60)] + [(i, "the rare one", "en", "s") for i in range(60, 64)]
    docs = odd_frame(spark, rows)
    items = [(1, "same words"), (2, "the rare"), (3, "one")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(lexical_search(docs, queries, block_rows=16)) == brute([(i, t) for i, t, *_ in rows], items)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12), st.integers(1, 12),
       st.sampled_from([1, 2, 8, 1000]), st.sampled_from([1, 7, 64, 1024]))
def test_skipping_equals_full_sums(seed, rows, n_lists, top, short, window):
    rng = np.random.default_rng(seed)
    lists, sums = [], np.zeros(rows, np.int64)
    for _ in range(n_lists):
        places = np.flatnonzero(rng.random(rows) < rng.choice([0.02, 0.3, 0.95]))
        if not len(places):
            continue
        scores = rng.integers(1, int(rng.choice([2, 5, 1000])) + 1, len(places))
        lists.append((places, scores, int(scores.max())))
        sums[places] += scores
    order = sorted((-s, p) for p, s in enumerate(sums.tolist()) if s)[:top]
    if lists:
        at, score = best(lists, rows, top, short, window)
        assert [(-s, p) for p, s in zip(at.tolist(), score.tolist(), strict=True)] == order
