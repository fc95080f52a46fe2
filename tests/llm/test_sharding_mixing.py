import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablelens.llm.mixing import mix, op5_mixing, schedule
from tablelens.llm.sharding import op2_sharding, shard_by_bytes

from .conftest import SMALL


def test_shards_are_contiguous_and_even(spark, small):
    got = sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard)
                 for r in op2_sharding(spark, SMALL).collect())
    sizes = [len(t.encode()) + 1 for _, t, *_ in small]
    total, before, slots, want = sum(sizes), 0, defaultdict(int), []
    for (i, t, *_), size in zip(small, sizes, strict=True):
        shard = min(15, (2 * before + size) * 16 // (2 * total))
        want.append((i, size, zlib.crc32(t.encode()), "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    assert got == want


def test_shards_of_odd_rows(odd, none):
    rows = shard_by_bytes(odd, shards=3).collect()
    assert len(rows) == odd.count()
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shard_by_bytes(none).count() == 0
    with pytest.raises(ValueError):
        shard_by_bytes(odd, shards=0)


def edf(parts):
    """Earliest deadline first, step by step: the source of each slot of one period."""
    total, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // m), s) for s, m in parts.items() if done[s] < m and done[s] * total // m <= t]
        due, s = min(ready)
        assert t < due
        done[s] += 1
        out.append(s)
    return out


def brute_order(counts, parts, block):
    """Blocks in schedule order: (source, block number)."""
    left = {s: -(-n // block) for s, n in counts.items()}
    used, out = dict.fromkeys(counts, 0), []
    while any(left.values()):
        now = {s: min(parts[s], left[s]) for s in left if left[s]}
        for s in edf(dict(sorted(now.items()))):
            out.append((s, used[s]))
            used[s] += 1
        for s, m in now.items():
            left[s] -= m
    return out


@pytest.mark.parametrize("block", [1, 4])
def test_schedule_is_earliest_deadline_first(spark, block):
    counts = {"a": 137, "b": 61, "c": 5, "d": 1}
    weights = {"a": 5.0, "b": 3.0, "c": 1.5, "d": 0.5}
    docs = spark.createDataFrame([(k * 1000 + i, s, "t") for k, (s, n) in enumerate(counts.items()) for i in range(n)],
                                 "doc_id long, source string, text string")
    rows = schedule(docs, weights, parts=20, block_docs=block).orderBy("position").collect()
    assert len(rows) == sum(counts.values())
    order = list(dict.fromkeys((r.source, r.block) for r in rows))
    assert order == brute_order(counts, {"a": 10, "b": 6, "c": 3, "d": 1}, block)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    # less than one block from its share after every slot, while no source has ended
    full = [s for s, _ in order][:20 if block == 1 else 0]
    for s, share in {"a": 0.5, "b": 0.3}.items():
        seen = 0
        for t, x in enumerate(full, 1):
            seen += x == s
            assert abs(seen - share * t) < 1


def test_mixing_keeps_all_rows(spark, odd, none):
    got = mix(odd).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, odd.collect()))
    assert mix(odd).columns == odd.columns
    assert mix(none).count() == 0 and schedule(none).count() == 0
    whole = op5_mixing(spark, SMALL)
    assert whole.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert whole.select("position").distinct().count() == whole.count()
    assert whole.where((F.col("release") > F.col("slot")) | (F.col("deadline") <= F.col("slot"))).count() == 0


def test_mix_sorts_by_the_schedule(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [r.doc_id for r in schedule(docs).orderBy("position").collect()]
    assert [r.doc_id for r in mix(docs).collect()] == want
