"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import ranked, table, written

PARTS = 1000
BLOCK_DOCS = 8
TEMPERATURE = 0.5

# One period of the schedule, slot by slot. ``jobs`` holds a struct (no, m) for each source that
# takes part, ``total`` the sum of m. Job d (from 0) of a source is released at
# floor(d * total / m) and due at ceil((d + 1) * total / m); of the released jobs the one
# due first (then the first source) gets the slot.
PERIOD = """
aggregate(
  sequence(0L, total - 1),
  named_struct('done', transform(jobs, x -> 0L), 'picked', cast(array() as array<int>)),
  (s, t) -> transform(
    array(array_min(filter(
      transform(jobs, (x, i) -> if(s.done[i] < x.m and s.done[i] * total div x.m <= t,
        named_struct('due', ((s.done[i] + 1) * total + x.m - 1) div x.m, 'i', i), null)),
      y -> y is not null)).i),
    p -> named_struct('done', transform(s.done, (d, i) -> if(i = p, d + 1, d)),
                      'picked', concat(s.picked, array(p))))[0],
  s -> s.picked)
"""


def source_parts(counts: DataFrame, weights: dict[str | None, float] | None, parts: int,
                 block_docs: int, temperature: float) -> DataFrame:
    """(source, blocks, a): each source's blocks and its whole parts of a period, at least one.

    Without ``weights`` a source of n documents weighs n to the power ``temperature``.
    """
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(temperature))
    else:
        given = F.lit(0.0)
        for source, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(given)
        weight = given
    weighed = counts.select("source", F.ceil(F.col("n") / block_docs).alias("blocks"), weight.alias("w"))
    total = weighed.agg(F.sum("w").alias("all_w"))
    return weighed.join(F.broadcast(total)).select(
        "source", "blocks", F.greatest(F.lit(1), F.round(F.lit(parts) * F.col("w") / F.greatest("all_w", F.lit(1e-9))))
        .cast("long").alias("a"))


def periods_and_slots(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schedule as two small tables: (r, k, start, total) and (k, source, j, slot, m).

    A period deals ``a`` blocks of every source that still has them; the period in which
    a source ends deals what is left of it. So periods differ only where a source ends:
    there are at most two kinds ``k`` more for each source, and one schedule per kind.
    """
    ends = sources.select("source", "a", "blocks", (F.expr("blocks div a")).alias("full"),
                          (F.col("blocks") % F.col("a")).alias("rest"))
    breaks = ends.select(F.explode(F.array(F.lit(0).cast("long"), "full", F.col("full") + 1)).alias("r0")).distinct()
    held = breaks.join(ends, F.col("r0") <= F.col("full")).select(
        "r0", "source", "blocks", "a",
        F.when(F.col("r0") < F.col("full"), F.col("a")).otherwise(F.col("rest")).alias("m"))
    following = breaks.select(F.col("r0").alias("_r0"), F.expr("lead(r0) over (order by r0)").alias("r1"))
    kinds = held.groupBy("r0").agg(
        F.sum("m").alias("total"),
        F.sort_array(F.collect_list(F.when(F.col("m") > 0, F.struct("source", "m")))).alias("jobs")
    ).where(F.col("total") > 0).join(following, F.col("r0") == F.col("_r0")).withColumn(
        "times", F.coalesce("r1", F.col("r0") + 1) - F.col("r0"))
    earlier = Window.orderBy("r0").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("base", F.coalesce(F.sum(F.col("times") * F.col("total")).over(earlier), F.lit(0)))
    slots = kinds.select(F.col("r0").alias("k"), "total", "jobs", F.expr(PERIOD).alias("picked")).select(
        "k", "total", "jobs", F.posexplode("picked").alias("slot", "i")).select(
        "k", "slot", F.expr("jobs[i].source").alias("source"), F.expr("jobs[i].m").alias("m"),
        (F.expr("row_number() over (partition by k, i order by slot)") - 1).cast("long").alias("j"))
    periods = kinds.select(
        F.explode(F.sequence("r0", F.col("r0") + F.col("times") - 1)).alias("r"),
        F.col("r0").alias("k"), "r0", "base", "total").select(
        "r", "k", "total", (F.col("base") + (F.col("r") - F.col("r0")) * F.col("total")).alias("start"))
    return periods, slots


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, parts: int = PARTS,
             block_docs: int = BLOCK_DOCS, temperature: float = TEMPERATURE, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text") -> DataFrame:
    """An order of all documents in which every source keeps its target weight throughout.

    Each source's documents, in id order, form blocks of ``block_docs``. Time runs in
    periods in which a source of weight ``a`` (its whole parts of ``parts``) gets
    ``a`` slots. Its blocks are released and due at even distances, and the earliest
    deadline wins a slot, so that after every slot each source is less than one
    block away from its share. Nothing is dropped or repeated: when a
    source ends, the others share its slots in proportion.

    Returns doc_id, source, text_hash, block, weight (the share in the block's
    period), release, deadline, slot (of the block; release <= slot < deadline) and
    position (slot * block_docs + place in the block: unique and
    ascending, with gaps only behind a source's last block). Cases: a null source is a
    source of its own; null ids come first; rows of equal id are ordered by text hash,
    equal rows follow each other; sources without a given weight get one part; an
    empty table gives no rows; other columns are ignored.
    """
    if parts < 1 or block_docs < 1:
        raise ValueError("parts and block_docs must be 1 or more")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    placed = ranked(rows, ["doc_id", "text_hash"], by=["source"], name="mixing")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = written(source_parts(counts, weights, parts, block_docs, temperature).coalesce(1), "sources")
    periods, slots = (written(x, n) for x, n in zip(periods_and_slots(sources), ("periods", "slots"), strict=True))
    own = sources.select(F.col("source").alias("_source"), "a")
    blocks = placed.withColumn("block", F.expr(f"pos div {block_docs}")).join(
        own, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "text_hash", "block", (F.col("pos") % block_docs).alias("place"),
        F.expr("block div a").alias("_r"), (F.col("block") % F.col("a")).alias("_j"))
    timed = blocks.join(periods, F.col("_r") == F.col("r")).join(
        slots.select(F.col("k").alias("_k"), F.col("source").alias("_source"), "j", "m", F.col("slot").alias("at")),
        (F.col("k") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_j") == F.col("j")))
    return timed.select(
        "doc_id", "source", "text_hash", "block", (F.col("m") / F.col("total")).alias("weight"),
        (F.col("start") + F.expr("j * total div m")).alias("release"),
        (F.col("start") + F.expr("((j + 1) * total + m - 1) div m")).alias("deadline"),
        (F.col("start") + F.col("at")).alias("slot"),
        ((F.col("start") + F.col("at")) * block_docs + F.col("place")).alias("position"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` itself, all columns, sorted by the position of ``schedule``.

    Cases as there; among fully equal rows it doesn't matter which gets which place.
    """
    order = schedule(docs, weights, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    places = order.groupBy("doc_id", "source", "text_hash").agg(
        F.sort_array(F.collect_list("position")).alias("places"))
    packed = docs.select(F.struct("*").alias("row"))
    keys = {"doc_id": F.col(f"row.`{id_col}`"), "source": F.col(f"row.`{source_col}`"),
            "text_hash": F.xxhash64(F.col(f"row.`{text_col}`"))}
    packed = packed.select("row", *[c.alias(f"_{k}") for k, c in keys.items()])
    same = F.col("_text_hash") == F.col("text_hash")
    for k in ("doc_id", "source"):
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    joined = packed.join(places, same).withColumn("_copy", F.expr(
        "row_number() over (partition by _doc_id, _source, _text_hash order by 1)"))
    return joined.withColumn("_position", F.expr("places[_copy - 1]")).orderBy("_position").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents")).drop("text_hash")
