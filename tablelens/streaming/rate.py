"""Rate admission on a stream (R2): the R1 rule, whatever the micro-batches.

Events are judged in the order of their times, not of their arrival: a key's events wait in its
state until the watermark has passed them, when nothing earlier can come any more, and are
then judged in time order. So the decisions are those of the batch operator for any
split of the events into files or micro-batches, as long as no event is later than the
watermark allows. A later one comes out at once, not allowed and marked as late; one that is
later by more than ``grace`` besides is dropped by Spark before this operator sees it. Events without a
time wait for nothing: they are not allowed, as in the batch operator.

Keys are dealt by hash into buckets, and a bucket is one group of Spark's: a micro-batch costs a
call per bucket and some work per event, not a call per key. The state of a bucket is its waiting
events (those of the watermark's length) and the times of its keys' admitted events that can still
matter (at most ``limit`` a key, inside the window), as two compressed Arrow tables. An event-time
timeout wakes a bucket when its first waiting event is due, also if it gets no new events, and at last
drops an idle one. Events that are still within the watermark when a stream
ends stay in the state; the next events, of any key, release them.
"""

from __future__ import annotations

import sys
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.columns import qcol
from ..operators.rate import admit, epoch_micros

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _millis(interval: str) -> int:
    return int(round(pd.Timedelta(interval).total_seconds() * 1000))


def _pack(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_all().to_pandas()


def _numbers(values: pd.Series, absent: pd.Series) -> np.ndarray:
    """A number for each value, the same for equal ones and in their order, the absent ones first."""
    return np.where(absent, -1, pd.factorize(values, sort=True)[0])


def rate_admission_stream(events: DataFrame, key: str, ts: str, event_id: str, limit: int,
                          window_seconds: float, watermark: str = "1 hour", grace: str = "7 days",
                          buckets: int = 256) -> DataFrame:
    """Streaming rows ``(key, event_id, ts, allowed, late)`` in append mode.

    ``watermark``: how much later than the newest event seen before an event may come and still be judged
    in its place; ``grace``: how much later than that it is still given out, as late. ``buckets``: groups of
    keys; a micro-batch reads and writes the state of each it has events of, so more of them suit more keys and
    events. It belongs to the checkpoint: a stream goes on with the number it began with.
    """
    window_us, grace_ms = int(round(float(window_seconds) * 1_000_000)), _millis(grace)
    limit = int(limit)
    key_type, id_type = events.schema[key].dataType, events.schema[event_id].dataType
    out_schema = T.StructType([T.StructField(n, t) for n, t in (
        ("_key", key_type), ("_no_key", T.BooleanType()), ("_t", T.LongType()), ("_id", id_type),
        ("_no_id", T.BooleanType()), ("allowed", T.BooleanType()), ("late", T.BooleanType()))])
    delay_ms = _millis(watermark) + grace_ms
    rows = events.select(qcol(key).alias("_key"), qcol(event_id).alias("_id"), qcol(ts).cast("timestamp_ntz").alias("_ts"))
    # absent keys and ids are marked aside: pandas turns integers with nulls into doubles
    whole = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)) if isinstance(kind, T.IntegralType) else F.col(c)
    staged = rows.where(F.col("_ts").isNotNull()).select(
        whole("_key", key_type).alias("_key"), F.isnull("_key").alias("_no_key"), epoch_micros(F.col("_ts")).alias("_t"),
        whole("_id", id_type).alias("_id"), F.isnull("_id").alias("_no_id"), F.col("_ts").cast("timestamp").alias("_wm"),
        F.pmod(F.xxhash64("_key"), F.lit(int(buckets))).alias("_bucket")).withWatermark("_wm", f"{delay_ms} milliseconds")
    own, columns = ["_key", "_no_key"], ["_key", "_no_key", "_t", "_id", "_no_id"]

    def fold(_, pdfs, state):
        kept, waiting = [_unpack(x) for x in state.get] if state.exists else [pd.DataFrame(columns=c) for c in ([*own, "_t"], columns)]
        mark = state.getCurrentWatermarkMs()
        # Spark's watermark is late by the grace as well; 0 means that there is none yet
        due = (mark + grace_ms) * 1000 if mark > 0 else None
        came = [p[columns] for p in pdfs] if not state.hasTimedOut else []
        late = [p[p["_t"] < due] for p in came] if due is not None else []
        came = [p[p["_t"] >= due] for p in came] if due is not None else came
        both = [p for p in (waiting, *came) if len(p)]
        waiting = pd.concat(both, ignore_index=True) if both else waiting
        ready = waiting[waiting["_t"] < due] if due is not None else waiting[:0]
        waiting = waiting[waiting["_t"] >= due] if due is not None else waiting
        if len(ready):
            owners = pd.concat([p[own] for p in (kept, ready) if len(p)], ignore_index=True)
            number = pd.factorize(owners["_key"], use_na_sentinel=False)[0] * 2 + owners["_no_key"].to_numpy(dtype=bool)
            held = {}
            for k, t in zip(number[:len(kept)].tolist(), kept["_t"].tolist()):
                held.setdefault(k, deque()).append(t)
            at = number[len(kept):]
            order = np.lexsort((_numbers(ready["_id"], ready["_no_id"]), ready["_t"].to_numpy(), at))
            ready = ready.iloc[order]
            allowed = admit(at[order].tolist(), ready["_t"].tolist(), limit, window_us, held)
            ready = ready.assign(allowed=allowed, late=False)
            first = dict(zip(*(x.tolist() for x in np.unique(number, return_index=True))))
            kept = owners.iloc[[first[k] for k, q in held.items() for _ in q]].assign(_t=[t for q in held.values() for t in q])
        if due is not None and len(kept):
            kept = kept[kept["_t"] > due - window_us]  # no event to come reaches further back
        if len(waiting) or len(kept):
            state.update((_pack(kept), _pack(waiting)))
            # the first waiting event's time, or that from which the admitted ones can't matter, by Spark's watermark
            wake = int(waiting["_t"].min() if len(waiting) else kept["_t"].max() + window_us) // 1000 - grace_ms
            state.setTimeoutTimestamp(max(wake, mark + 1, 1))
        elif state.exists:
            state.remove()
        for out in (ready, *(p.assign(allowed=False, late=True) for p in late)):
            if len(out):
                yield out

    judged = staged.groupBy("_bucket").applyInPandasWithState(
        fold, out_schema, "kept binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    judged = judged.select(
        F.when(~F.col("_no_key"), F.col("_key")).alias(key), F.when(~F.col("_no_id"), F.col("_id")).alias(event_id),
        F.timestamp_add("MICROSECOND", F.col("_t"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias(ts), "allowed", "late")
    undated = rows.where(F.col("_ts").isNull()).select(
        F.col("_key").alias(key), F.col("_id").alias(event_id), F.col("_ts").alias(ts), F.lit(False).alias("allowed"), F.lit(False).alias("late"))
    return judged.unionByName(undated)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Drain all available input into a table (trigger availableNow)."""
    q = (stream.writeStream.format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
