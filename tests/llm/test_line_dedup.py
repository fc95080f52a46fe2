import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tablelens.llm.cuckoo import CuckooFilter, as_words
from tablelens.llm.line_dedup import (counts, dedup_lines, delete, filters, insert, op8_line_dedup, references,
                                      update_filters)

from .conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs):
    """(text kept, lines, dropped) of each (id, text)."""
    low = float("-inf")
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (low if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in dedup_lines(df, **options).collect()),
                  key=repr)


def test_smallest_table(spark, small):
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op8_line_dedup(spark, SMALL).collect())
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest())
                         for i, t, n, d in brute([(i, t) for i, t, *_ in small], 5))


@pytest.mark.parametrize("min_docs", [2, 5])
@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_odd_rows(odd, min_docs, filter_bytes):
    """Also when no filter may be sent around: the exact table alone gives the same."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, min_docs=min_docs, filter_bytes=filter_bytes) == brute(rows, min_docs)


def test_empty_table(none):
    assert dedup_lines(none).count() == 0


def test_all_columns_pass(odd):
    assert sorted(repr(r.row) for r in dedup_lines(odd).collect()) == sorted(map(repr, odd.collect()))


def test_deletions_undo_insertions(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, second = docs.where("doc_id < 120"), docs.where("doc_id >= 120")
    state = references(first)
    grown = insert(state, references(second))
    whole = lambda refs: sorted((bytes(r.key), r.n_docs, r.last_holder) for r in counts(refs).collect())
    assert whole(grown) == whole(references(docs))
    assert whole(delete(grown, second.select("doc_id"))) == whole(state)
    assert whole(insert(grown, state)) == whole(grown)


def test_filters_follow_changes(spark):
    rng = random.Random(3)
    keys = [rng.randbytes(16) for _ in range(600)]
    frame = lambda ks: spark.createDataFrame([(k[8] % 4, bytearray(k)) for k in ks], "shard int, key binary")
    built = filters(frame(keys[:400]))
    moved = update_filters(built, frame(keys[:100]), frame(keys[400:])).collect()
    for r in moved:
        own = CuckooFilter.from_bytes(bytes(r.filter))
        inside = [k for k in keys[100:] if k[8] % 4 == r.shard]
        assert own.contains(as_words(inside)).all()
        gone = [k for k in keys[:100] if k[8] % 4 == r.shard]
        assert own.contains(as_words(gone)).mean() < 0.1


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (20000, 2), dtype=np.uint64)
    made = CuckooFilter.build(words[:10000])
    assert made.contains(words[:10000]).all()
    assert made.contains(words[10000:]).mean() < 0.002
    made.remove(words[:5000])
    assert made.contains(words[5000:10000]).all()
    assert made.contains(words[:5000]).mean() < 0.002
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert (again.slots == made.slots).all()


def test_shards_follow_the_documents():
    from tablelens.llm.line_dedup import SHARD_DOCS, SHARDS, shards_for

    assert [shards_for(n) for n in (0, 1, SHARDS * SHARD_DOCS, SHARDS * SHARD_DOCS + 1, 10**9)] == [
        SHARDS, SHARDS, SHARDS, 2 * SHARDS, 65536]
