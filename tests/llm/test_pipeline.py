from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tablelens.llm.common import written
from tablelens.llm.mixing import mix, schedule
from tablelens.llm.packing import in_file_order
from tablelens.llm.quality import quality_rules

from .conftest import SMALL
from .test_line_dedup import brute
from .test_simhash import brute_groups


def test_every_stage_against_brute_force(spark, labels):
    """Each stage on the whole output of the one before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "line_dedup", "simhash_dedup", "mixing", "best_fit_packing"]

    judged = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    good = written(steps["quality_rules"](spark, docs, SMALL), "good")
    assert good.columns == columns
    assert sorted(map(tuple, good.collect())) == sorted(tuple(r) for r in docs.collect() if judged[r.doc_id].kept)

    lines = written(steps["line_dedup"](spark, good, SMALL), "lines")
    assert lines.columns == columns
    want = {i: t for i, t, _, _ in brute([(r.doc_id, r.text) for r in good.collect()], 5)}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, len(t)) for i, t in want.items()}

    single = written(steps["simhash_dedup"](spark, lines, SMALL), "single")
    assert single.columns == columns
    groups = brute_groups([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups})

    mixed = written(steps["mixing"](spark, single, SMALL), "mixed")
    assert mixed.columns == columns
    order = [r.doc_id for r in schedule(single).orderBy("position").collect()]
    assert [r.doc_id for r in mixed.coalesce(1).collect()] == order or sorted(order) == sorted(r.doc_id for r in mixed.collect())

    packed = steps["best_fit_packing"](spark, mixed, SMALL)
    assert sorted(r.doc_id for r in packed.where("piece = 0").collect()) == sorted(order)
    whole = corpus_pipeline.run(spark, SMALL)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_sequences_follow_the_schedule(spark):
    """Over many files, every tenth of the sequences holds the sources by their target weights."""
    source = F.when(F.col("id") < 3200, "a").when(F.col("id") < 4000, "b").otherwise("c")
    docs = written(spark.range(4200).select(
        F.col("id").alias("doc_id"), source.alias("source"),
        F.array_join(F.array_repeat(F.lit("word"), (50 + F.xxhash64("id") % 50 * 30 + 1500).cast("int")), " ").alias("text")),
        "unmixed")
    steps = dict(corpus_pipeline.STAGES)
    many = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        mixed = written(mix(docs, parts=20), "mixed")
        assert len(mixed.inputFiles()) > 10
        order = [r.doc_id for r in schedule(docs, parts=20).orderBy("position").collect()]
        got = {r.doc_id: r.place for r in in_file_order(mixed, "place").select("doc_id", "place").collect()}
        assert sorted(got, key=got.get) == order and sorted(got.values()) == list(range(4200))
        rows = steps["best_fit_packing"](spark, mixed, SMALL).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in rows if r.piece == 0) == list(range(4200))
    last = max(r.sequence_id for r in rows) + 1
    assert {r.sequence_id for r in rows} == set(range(last)) and last > 500
    name = lambda i: "a" if i < 3200 else "b" if i < 4000 else "c"
    first = Counter(name(i) for i in order[:len(order) // 10])
    for k in range(10):
        held = [r for r in rows if 10 * r.sequence_id // last == k]
        wanted = Counter(name(i) for i in order[k * 420:(k + 1) * 420])
        share = Counter(name(r.doc_id) for r in held)
        assert all(abs(share[s] / len(held) - wanted[s] / 420) < 0.08 for s in "abc"), (k, share, wanted)
        near = sorted(abs(got[r.doc_id] / 4200 - (r.sequence_id + 0.5) / last) for r in held)
        assert near[len(near) // 2] < 0.05
    assert first["b"] > 0.2 * 420 and first["c"] > 0.1 * 420  # not the shares of the whole table


def test_pipeline_numbers_sequences_by_the_schedule(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, SMALL), name)
    place = {r.doc_id: i for i, r in enumerate(schedule(docs).orderBy("position").collect())}
    held = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        held.setdefault(r.sequence_id, []).append((place[r.doc_id] * r.length, r.length))
    means = [sum(x for x, _ in held[s]) / sum(n for _, n in held[s]) for s in range(len(held))]
    assert len(means) > 3 and means == sorted(means)


def test_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
