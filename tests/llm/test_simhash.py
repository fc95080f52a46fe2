import random
import re

import numpy as np
import xxhash

from tablelens.llm.components import connected_components
from tablelens.llm.simhash import fingerprint, keep_one, links, masks, near_groups, near_links, op6_simhash_dedup

from .conftest import SMALL


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    return [root(x) for x in range(n)]


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    joined = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a)
                               if (prints[a] ^ prints[b]).bit_count() <= 4])
    low = {}
    for r, (i, _) in zip(joined, rows, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted(((i, p, low.get(r)) for (i, _), p, r in zip(rows, prints, joined, strict=True)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_groups(df).collect()), key=repr)


def test_smallest_table(spark, small):
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id)
                  for r in op6_simhash_dedup(spark, SMALL).collect()), key=repr)
    assert got == brute_groups([(i, t) for i, t, *_ in small])


def test_odd_rows(odd, none):
    assert found(odd) == brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert near_groups(none).count() == 0 and keep_one(none).count() == 0


def test_keep_one(odd):
    rows = odd.collect()
    least = {c for i, _, c in brute_groups([(r.doc_id, r.text) for r in rows]) if i is not None}
    kept = keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least)
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in rows)
    assert keep_one(odd).columns == odd.columns


def test_links_find_every_near_pair():
    rng = random.Random(5)
    values, groups = [], []
    for g in range(40):
        heart = rng.getrandbits(64)
        for _ in range(rng.randint(1, 90)):
            x = heart
            for b in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << b
            values.append(x)
            groups.append(g)
    v = np.array(values, dtype=np.uint64)
    for radius in (1, 3, 4, 6):
        a, b = links(v, np.array(groups), radius)
        assert all(groups[x] == groups[y] and (values[x] ^ values[y]).bit_count() <= radius for x, y in zip(a, b, strict=True))
        every = [(x, y) for x in range(len(v)) for y in range(x) if groups[x] == groups[y]
                 and (values[x] ^ values[y]).bit_count() <= radius]
        same = lambda r: [r.index(x) for x in r]
        assert same(roots(len(v), zip(a.tolist(), b.tolist(), strict=True))) == same(roots(len(v), every))


def test_masks_leave_no_pair_apart():
    rng = random.Random(2)
    made = masks(4, 6)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in made)


def test_crowded_keys_are_compared_in_cells(spark):
    """A group larger than a chunk is still joined whole."""
    rng = random.Random(7)
    heart = rng.getrandbits(63)
    prints = sorted({heart ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)})
    fps = spark.createDataFrame([(x,) for x in prints], "fp long")
    edges = near_links(fps, 4, 6, chunk=16)
    got = connected_components(edges).collect()
    assert {r.component for r in got} == {min(prints)} and len(got) == len(prints)


def test_components(spark, none):
    rng = random.Random(11)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    joined = roots(300, pairs)
    low = {r: min(i for i in range(300) if joined[i] == r) for r in set(joined)}
    assert got == {x: low[joined[x]] for p in pairs for x in p if p[0] != p[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(40000))
    assert fingerprint(text) == brute_fingerprint(text)


def test_no_text_is_lost(spark):
    """Repeated and missing ids: each group keeps one row, whatever the ids."""
    from tablelens.llm.simhash import keep_one

    rng = random.Random(31)
    a, b = (" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(99))
                     for _ in range(80)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "x"), (2, b + " more", "x"), (None, a, "x"), (None, a, "y"), (5, None, "x"), (4, "", "x"), (4, "", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    assert sorted((r.doc_id, r.text) for r in keep_one(frame).collect()) == sorted([(1, a), (1, b), (4, "")])
    alone = spark.createDataFrame([(None, a, "x"), (None, a, "y"), (None, b, "x")], "doc_id long, text string, h1 string")
    assert sorted(r.text for r in keep_one(alone).collect()) == sorted([a, b])
    assert keep_one(frame.limit(0)).count() == 0
