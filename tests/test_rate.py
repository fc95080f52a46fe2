import datetime as dt
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from tablelens.operators import rate as R
from tablelens.operators import retention as RT
from tablelens.streaming.rate import rate_admission_stream, run_to_table

EVENTS = "/root/testdata/sf0.001/events.parquet"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def test_limit_and_independent_clients(spark):
    rows = [(i, "a", T0 + dt.timedelta(seconds=i)) for i in range(6)] + \
           [(10, "b", T0 + dt.timedelta(seconds=5))]
    df = spark.createDataFrame(rows, "id int, client string, ts timestamp_ntz")
    got = {r.id: r.allowed for r in R.rate_admission(df, "client", "ts", 5, 60, "id").collect()}
    assert [got[i] for i in range(6)] == [True] * 5 + [False]
    assert got[10] is True


def test_rejected_events_do_not_count(spark):
    # limit 1 per 60 s: 0 allowed, 50 refused, 70 allowed (0 expired; 50 never counted)
    rows = [(1, "a", T0), (2, "a", T0 + dt.timedelta(seconds=50)),
            (3, "a", T0 + dt.timedelta(seconds=70))]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    got = [r.allowed for r in R.rate_admission(df, "k", "ts", 1, 60, "id").orderBy("id").collect()]
    assert got == [True, False, True]
    plain = [r.allowed for r in R.rate_window_count(df, "k", "ts", 1, 60).orderBy("id").collect()]
    assert plain == [True, False, False]  # the plain window counts the refused one


def run_stream(spark, frames, watermark, limit, window, files=1, close=True, **more):
    """The stream's rows for frames written one after another, a closing event of nobody last."""
    base = tempfile.mkdtemp(prefix="rate-stream-")
    src = os.path.join(base, "src")
    schema = "event_id long, user_id long, ts timestamp_ntz"
    if close:
        frames = [*frames, spark.createDataFrame([(-1, -1, dt.datetime(2030, 1, 1))], schema)]
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(os.path.join(src, f"part{i:03}"))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option(
        "recursiveFileLookup", "true").parquet(src)
    out = rate_admission_stream(stream, "user_id", "ts", "event_id", limit, window, watermark=watermark, **more)
    run_to_table(out, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    rows = spark.read.parquet(os.path.join(base, "out")).collect()
    return {r.event_id: (r.allowed, r.late) for r in rows}, len(rows)


def test_stream_equals_batch_for_any_split(spark):
    """Uneven stretches, files in shuffled order within the watermark, null times and keys, ties."""
    rng = random.Random(11)
    rows, t = [], T0
    for i in range(400):
        t += dt.timedelta(seconds=rng.choice([0, 1, 1, 2, 30, 200]))
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), t))
    rows += [(1000 + i, rng.choice([1, None]), None) for i in range(5)]
    schema = "event_id long, user_id long, ts timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    batch = {r.event_id: (r.allowed, False) for r in R.rate_admission(df, "user_id", "ts", 3, 60, "event_id").collect()}
    assert 0 < sum(a for a, _ in batch.values()) < len(batch)
    span = rows[399][2] - T0
    for files, pieces, watermark in ((1, 5, "100 days"), (2, 9, f"{span.total_seconds() / 3} seconds")):
        cuts = sorted(rng.sample(range(400), pieces - 1))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 405])]
        if watermark == "100 days":
            rng.shuffle(parts)  # any order at all
        else:
            held = []  # each event at most a sixth of the time late
            for x in rows:
                late = dt.timedelta(seconds=rng.random() * span.total_seconds() / 6)
                held.append((x[2] or T0, late, x))
            held.sort(key=lambda x: x[0] + x[1])
            parts = [[x for *_, x in held[a:b]] for a, b in zip([0, *cuts], [*cuts, 405])]
        got, n = run_stream(spark, [spark.createDataFrame(x, schema) for x in parts if x], watermark, 3, 60, files)
        assert got == batch and n == len(batch)


def test_open_events_wait_and_late_ones_are_marked(spark):
    schema = "event_id long, user_id long, ts timestamp_ntz"
    frame = lambda rows: spark.createDataFrame([(n, 1, T0 + dt.timedelta(seconds=s)) for n, s in rows], schema)
    # the watermark is Spark's, of the batch before: 440 when event 3 comes, 450 when event 6 does
    frames = [frame([(1, 0), (2, 500)]), frame([(4, 505)]), frame([(3, 10), (5, 510)]), frame([(6, 460)])]
    got, _ = run_stream(spark, frames, "60 seconds", 5, 30, close=False, grace="1 hour")
    assert got == {1: (True, False), 3: (False, True)}  # nothing later says that the others are due
    got, _ = run_stream(spark, frames, "60 seconds", 1, 50, grace="1 hour")
    assert got == {1: (True, False), 3: (False, True), 6: (True, False), 2: (False, False), 4: (False, False), 5: (True, False)}


def test_retention(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [(1, now - dt.timedelta(hours=100), "x" * 10), (2, now - dt.timedelta(hours=1), "y"),
            (3, now - dt.timedelta(hours=72), "zz")]
    df = spark.createDataFrame(rows, "id int, created timestamp_ntz, payload string")
    r = RT.retention_report(df, "created", 72, now=now, size_col="payload").collect()[0]
    assert (r.expired_count, r.expired_bytes, r.kept_count) == (1, 10, 2)
    kept = sorted(x.id for x in RT.apply_retention(df, "created", 72, now=now).collect())
    assert kept == [2, 3]
    empty = spark.createDataFrame([], "id int, created timestamp_ntz, payload string")
    assert tuple(RT.retention_report(empty, "created", 72, now=now).collect()[0]) == (0, 0, 0)


def test_retention_filter_reaches_scan(spark):
    df = spark.read.parquet(EVENTS)
    plan = RT.apply_retention(df, "ts", 72, now=dt.datetime(2024, 1, 20))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "ts" in plan


def test_rank_items(spark):
    rows = [(0, "q0", "90", "80"), (1, "q1", "90", "80"), (2, "  ", "99", "99"),
            (3, "q3", "n/a", "70"), (4, "q4", None, None), (5, "q5", "95", "10")]
    df = spark.createDataFrame(rows, "pos int, q string, rel string, sig string")
    got = [(r["rank"], r.q, r.relevance, r.significance) for r in
           RT.rank_items(df, "q", "rel", "sig", "pos").collect()]
    assert got == [(1, "q5", 95.0, 10.0), (2, "q0", 90.0, 80.0), (3, "q1", 90.0, 80.0),
                   (4, "q3", 50.0, 50.0), (5, "q4", 50.0, 50.0)]


def test_window_count_chunking_is_exact(spark):
    ev = spark.read.parquet(EVENTS).select("event_id", "user_id", "ts")
    one = {r.event_id: r.recent for r in R.rate_window_count(ev, "user_id", "ts", 2, 7200, 1).collect()}
    whole = {r.event_id: r.recent for r in
             R.rate_window_count(ev, "user_id", "ts", 2, 7200, 10 ** 6).collect()}
    assert one == whole and max(one.values()) >= 1


def test_admission_independent_of_partitioning(spark):
    """A re-run with another layout (as after a lost executor) decides the same,
    also without a tiebreak column (ties broken by the remaining columns)."""
    ev = spark.read.parquet(EVENTS).select("event_id", "user_id", "ts", "value")
    a = {r.event_id: r.allowed for r in
         R.rate_admission(ev.repartition(3), "user_id", "ts", 2, 86400, num_partitions=3).collect()}
    b = {r.event_id: r.allowed for r in
         R.rate_admission(ev.repartition(7), "user_id", "ts", 2, 86400, num_partitions=7).collect()}
    assert a == b


def test_keys_of_any_value_stay_apart(spark):
    big = 2**53
    rows = [(big, 0), (big + 1, 1), (big, 2), (None, 3), (None, 4), (big + 1, 5)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), big + 7) for k, s in rows],
                               "k bigint, ts timestamp_ntz, other bigint")
    got = sorted((r.ts, r.k, r.allowed, r.other) for r in R.rate_admission(df, "k", "ts", 1, 60).collect())
    assert [(k, a) for _, k, a, _ in got] == [(big, True), (big + 1, True), (big, False), (None, True), (None, False),
                                            (big + 1, False)]
    assert {o for *_, o in got} == {big + 7}


def test_a_busy_key_is_cut_where_a_window_is_empty(spark):
    """Islands give the same decisions as one fold over the whole key."""
    import random
    from collections import deque

    rng = random.Random(2)
    times, t = [], 0
    for _ in range(600):
        t += rng.choice([1, 3, 8, 20, 130, 400])
        times.append(t)
    df = spark.createDataFrame([(i, "busy", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(times)],
                               "id int, k string, ts timestamp_ntz")
    want, held = {}, deque()
    for i, s in enumerate(times):
        while held and held[0] <= s - 60:
            held.popleft()
        want[i] = len(held) < 3
        if want[i]:
            held.append(s)
    assert {r.id: r.allowed for r in R.rate_admission(df, "k", "ts", 3, 60, "id").collect()} == want
    staged = df.select(F.col("k").alias("_key"), R.epoch_micros(F.col("ts")).alias("_t"))
    assert R._islands(staged, 60_000_000).select("_island").distinct().count() > 50


def test_rows_behind_the_grace_are_absent(spark):
    schema = "event_id long, user_id long, ts timestamp_ntz"
    frame = lambda rows: spark.createDataFrame([(n, 1, T0 + dt.timedelta(seconds=s)) for n, s in rows], schema)
    frames = [frame([(1, 0), (2, 500)]), frame([(4, 505)]), frame([(3, 10), (5, 510)])]
    got, _ = run_stream(spark, frames, "60 seconds", 5, 30, grace="1 second")
    assert set(got) == {1, 2, 4, 5} and not any(late for _, late in got.values())


def test_stream_state_is_grouped_by_buckets_of_keys(spark):
    """A micro-batch costs a call for each bucket, not for each key; wide keys and ids with absent ones stay exact."""
    big = 2**53
    rows = [(big + i, None if i % 50 == 0 else big + i % 1500, T0 + dt.timedelta(seconds=i // 3)) for i in range(6000)]
    rows += [(None, big + 7, T0 + dt.timedelta(seconds=s)) for s in (9, 9, 900)]
    schema = "event_id long, user_id long, ts timestamp_ntz"
    base = tempfile.mkdtemp(prefix="rate-stream-")
    spark.createDataFrame(rows, schema).repartition(3, "event_id").write.parquet(f"{base}/src")
    stream = spark.readStream.schema(schema).parquet(f"{base}/src")
    # the times before the last 100 seconds are due when the first batch's watermark is known
    out = rate_admission_stream(stream, "user_id", "ts", "event_id", 2, 3600, watermark="100 seconds", grace="1 hour")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(
        availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 256
    fields = lambda df: sorted((r.ts, r.user_id or 0, r.event_id or 0, r.allowed) for r in df.collect())
    due = F.col("ts") < F.lit(rows[5999][2] - dt.timedelta(seconds=100)).cast("timestamp_ntz")
    want = fields(R.rate_admission(spark.createDataFrame(rows, schema), "user_id", "ts", 2, 3600, "event_id").where(due))
    assert fields(spark.read.parquet(f"{base}/out")) == want and 0 < sum(a for *_, a in want) < len(want)
