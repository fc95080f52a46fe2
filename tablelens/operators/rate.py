"""Per-key sliding-window rate admission (R1) and the plain window count (R1b).

Admission is order dependent: an event is allowed when fewer than ``limit``
*allowed* events of its key lie in ``(t - window, t]``; rejected events do
not count. No window function expresses that, so R1 is a streaming fold in
Arrow batches that carries at most ``limit`` timestamps. Where a key has no
event for a whole window, nothing earlier can matter: its events are cut there
into islands, found from the distinct pairs of key and window-wide time cell, and
each island is folded by itself. So a busy key is spread over as many tasks as it
has islands, and the memory of a task is bounded whatever a key's size.
"""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import qcol

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def epoch_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz/timestamp column,
    independent of the session time zone for timestamp_ntz."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def admit(keys: np.ndarray, times: np.ndarray, limit: int, window_us: int,
          state: dict | None = None) -> np.ndarray:
    """Sequential admission over rows sorted by (key, time, tiebreak).

    ``state`` maps a key to the deque of its admitted times; it is carried
    across batches (and across micro-batches in the streaming operator).
    """
    state = {} if state is None else state
    out = np.zeros(len(times), dtype=bool)
    cur_key, q = None, None
    for i in range(len(times)):
        k = keys[i]
        if q is None or k != cur_key:
            cur_key = k
            q = state.setdefault(k, deque())
        t = times[i]
        lo = t - window_us
        while q and q[0] <= lo:
            q.popleft()
        if len(q) < limit:
            q.append(t)
            out[i] = True
    return out


def _islands(staged: DataFrame, window_us: int) -> DataFrame:
    """``staged`` (``_key``, ``_t``, ...) with ``_island``: the first cell of its run of occupied cells.

    A cell is one window long, so events two cells apart are at least a window apart.
    Only distinct (key, cell) pairs are sorted by key, not the events. Events without a time have none.
    """
    staged = staged.withColumn("_cell", F.floor(F.col("_t") / F.lit(window_us)))
    cells = staged.select(F.col("_key").alias("_k"), F.col("_cell").alias("_c")).where(F.col("_c").isNotNull()).distinct()
    run = Window.partitionBy("_k").orderBy("_c")
    begins = F.coalesce(F.col("_c") - F.lag("_c").over(run) > 1, F.lit(True))
    cells = cells.withColumn("_begin", F.when(begins, F.col("_c")))
    cells = cells.select("_k", "_c", F.last("_begin", ignorenulls=True).over(run).alias("_island"))
    return staged.join(cells, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")), "left").drop(
        "_k", "_c", "_cell")


def rate_admission(df: DataFrame, key: str, ts: str, limit: int, window_seconds: float,
                   tiebreak: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Input rows plus ``allowed`` (boolean).

    Events of a key are judged in (ts, tiebreak) order; without a tiebreak
    column, ties are broken by the other columns so the order is total and a
    recomputed partition reproduces the same decisions. Events without a key are
    those of one client of their own; events without a time are not allowed.
    Python sees only keys and times; all columns pass through as they are. Without
    ``num_partitions`` Spark sets (and adapts) the number of tasks.
    """
    window_us = int(round(float(window_seconds) * 1_000_000))
    limit = int(limit)
    ties = [tiebreak] if tiebreak else sorted(c for c in df.columns if c not in (key, ts))
    whole = df.select(F.struct("*").alias("row"))
    field = lambda c: F.col("row").getField(c)
    staged = whole.select("row", field(key).alias("_key"), epoch_micros(field(ts)).alias("_t"),
                          *[field(c).alias(f"_tie{i}") for i, c in enumerate(ties)])
    # events without a time are dealt out by their other columns
    loose = F.pmod(F.xxhash64(*[f"_tie{i}" for i in range(len(ties))]), F.lit(1024)) if ties else F.lit(0).cast("long")
    dated = _islands(staged, window_us).withColumn("_island", F.coalesce("_island", loose))
    order = ["_key", "_island", "_t", *[f"_tie{i}" for i in range(len(ties))]]
    dealt = dated.repartition(*([num_partitions] if num_partitions else []), "_key", "_island").sortWithinPartitions(*order).select("row", "_key", "_island", "_t")
    schema = T.StructType([T.StructField("row", dealt.schema["row"].dataType),
                           T.StructField("allowed", T.BooleanType())])

    def run(batches):
        state, last = {}, None  # the admitted times of the group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = list(zip(batch.column("_key").to_pylist(), batch.column("_island").to_pylist(), strict=True))
            number, numbers = 0, np.zeros(len(groups), dtype=np.int64)
            for i, (own, before) in enumerate(zip(groups, [last, *groups], strict=False)):
                number += own != before
                numbers[i] = number
            # group 0 is the one carried over; later groups are new
            held = {0: state.get("open")} if state.get("open") is not None else {}
            times = batch.column("_t")
            dated = times.is_valid().to_numpy(zero_copy_only=False)
            allowed = np.zeros(len(groups), dtype=bool)
            allowed[dated] = admit(numbers[dated], times.drop_null().to_numpy(), limit, window_us, held)
            state, last = {"open": held.get(int(numbers[-1]))}, groups[-1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(allowed)], ["row", "allowed"])

    return dealt.mapInArrow(run, schema).select("row.*", "allowed")


def rate_window_count(df: DataFrame, key: str, ts: str, limit: int, window_seconds: float,
                      chunk_windows: int = 2) -> DataFrame:
    """Plain sliding count: ``recent`` = earlier events of the key in
    ``(t - window, t)`` (rejected ones included), ``allowed`` = recent < limit.

    The range window is partitioned by (key, time chunk) rather than by key
    alone, so a hot key is spread over as many tasks as its timeline has
    chunks. A chunk spans ``chunk_windows`` windows; the events of the last
    window before a chunk are copied into it as context rows (counted, not
    output), which is all a frame of one window can reach. The copy costs
    1/chunk_windows of the rows.
    """
    window_us = int(round(float(window_seconds) * 1_000_000))
    chunk_us = window_us * max(1, int(chunk_windows))
    t = epoch_micros(qcol(ts))
    base = df.withColumn("_t", t).withColumn("_chunk", F.floor(F.col("_t") / F.lit(chunk_us)))
    base = base.withColumn("_own", F.lit(True))
    # events within one window before the end of their chunk also feed the next chunk
    tail = base.where(F.col("_t") >= (F.col("_chunk") + 1) * F.lit(chunk_us) - F.lit(window_us)) \
        .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False))
    both = base.unionByName(tail)
    w = Window.partitionBy(qcol(key), F.col("_chunk")).orderBy(F.col("_t")) \
        .rangeBetween(-(window_us - 1), -1)
    out = both.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("_own")) \
        .withColumn("allowed", F.col("recent") < F.lit(int(limit)))
    return out.drop("_t", "_chunk", "_own")
