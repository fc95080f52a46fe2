import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from tablelens.llm.filter_audit import filter_audit, op11_filter_audit, potentials

from .conftest import SMALL

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, copy):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    upper = sum("A" <= c <= "Z" for c in text)
    return "".join(x for x, bad in (
        ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * upper > 10 * len(text)),
        ("D", any(c in "#$%&*|" for c in text)), ("E", copy)) if bad)


def brute(docs, labels):
    """Every document put through every order, one by one. docs: (id, text, lang)."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    ids = {}
    for i, t, _ in docs:
        ids.setdefault(t or "", []).append(i)
    first = lambda i: (i is None, i if i is not None else 0)
    rows = [(lang or "", i, fails(t or "", min(map(first, ids[t or ""])) < first(i))) for i, t, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[2]]
                left = [r for r in left if x not in r[2]]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(x in r[2] for r in own) - len(gone), sum(r[2] == x for r in own),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def got(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in frame.collect()}


def test_small_table(spark, small, labels):
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert got(op11_filter_audit(spark, SMALL)) == brute([(i, t, lang) for i, t, lang, _ in small], marks)


def test_odd_rows(spark, odd, none):
    marks = [(6, 1, 0), (7, 1, 1), (7, 0, 0), (9, None, 1), (None, 1, 1), (99, 1, 1), (12, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert got(filter_audit(odd, labels)) == brute(docs, marks)
    assert filter_audit(none, labels).count() == 0
    assert set(got(filter_audit(odd, labels.limit(0)))) == set(got(filter_audit(odd, labels)))


def test_copies_of_one_text(spark):
    docs = [(i, "a text that stands often", "en" if i % 2 else None) for i in range(40)] + [(None, "a text that stands often", "en")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert got(filter_audit(frame, labels)) == brute(docs, [(0, 1, 0)])


def test_potential_differences_are_shapley_values(spark):
    # a game that isn't a removal game: v by hand, three players
    v = [0, 1, 2, 6, 3, 4, 4, 12]
    q = spark.range(1).select(potentials(F.array(*[F.lit(x).cast("long") for x in v]), 3).alias("q")).first().q
    want = []
    for i in range(3):
        total = 0
        for order in permutations(range(3)):
            before = sum(1 << j for j in order[:order.index(i)])
            total += v[before | 1 << i] - v[before]
        want.append(total)
    assert [q[7] - 3 * q[7 ^ 1 << i] for i in range(3)] == want
    assert sum(want) == factorial(3) * v[7]


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "xy", "a"), (3, "xy", "a")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit(docs, labels, {"Y": F.col("text").contains("y")}, copies="Z").orderBy("filter_order", "step")
    assert [(r.filter, r.kept, r.removed, r.redundant, r.shapley) for r in rows.collect()] == [
        ("Y", 1, 2, 0, 3), ("Z", 1, 0, 1, 1), ("Z", 2, 1, 0, 1), ("Y", 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        filter_audit(docs, labels, {x: F.lit(True) for x in "ABCDFGHI"})
