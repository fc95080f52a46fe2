"""Interaction of document filters: removal games, their potentials and every order of filters."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import SPACE_CLASS, table, written

COUNTS = ("n", "good", "toxic")
MOST_FILTERS = 7

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters() -> dict[str, Column]:
    """The failure conditions A to D on the column ``text`` (no nulls)."""
    words = F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != "")
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * upper > 10 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by what they fail, bit i for the i-th filter.

    The last bit is the exact-copy filter: a document fails it if its text stands under
    a smaller id too. Copies are never joined to each other: all rows of a text fail the
    same other filters, so each text keeps the rows of its least id (a map-side minimum)
    and the others are what the totals leave over.
    """
    bits = len(filters)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    judged = rows.select("id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), mask.alias("mask"))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    held = written(judged.join(marked, F.col("id") == F.col("_id"), "left").groupBy(
        "digest", "id", "part").agg(F.first("mask").alias("mask"), F.count(F.lit(1)).alias("n"),
                                    flag("good"), flag("toxic")), "audited")
    one_id = held.groupBy("digest", "id").agg(
        F.first("mask").alias("mask"), F.collect_list(F.struct("part", *COUNTS)).alias("parts"))
    firsts = one_id.groupBy("digest").agg(
        F.min_by(F.struct("mask", "parts"), F.struct(F.col("id").isNull(), F.col("id"))).alias("first")).select(
        F.col("first.mask").alias("mask"), F.explode("first.parts").alias("p")).select("mask", "p.*")
    total = lambda x, names: x.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in names])
    copy = 1 << bits
    signed = total(held, COUNTS).withColumn("mask", F.col("mask") + copy).unionByName(
        total(firsts, COUNTS).select(
            "part", F.explode(F.array(F.struct(F.col("mask"), F.lit(1).alias("s")),
                                      F.struct((F.col("mask") + copy).alias("mask"), F.lit(-1).alias("s")))).alias("x"),
            *COUNTS).select("part", "x.mask", *[(F.col("x.s") * F.col(c)).alias(c) for c in COUNTS]))
    return total(signed, COUNTS)


def games(failed: DataFrame, filters: int) -> DataFrame:
    """One row per part: total and, for each count, the array of removals by coalition.

    ``removed_n[S]`` is what the filters of the coalition S (a bit mask) remove together.
    """
    size = 1 << filters
    wide = failed.select("part", "mask", *COUNTS, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("coalition"))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = wide.groupBy("part", "coalition").agg(
        F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in COUNTS])
    rows = sums.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(
        F.collect_list(F.struct("coalition", *COUNTS))).alias("by"))
    return rows.select("part", "total", *[F.col("by")[c].alias(f"removed_{c}") for c in COUNTS])


def potentials(removed: Column, filters: int) -> Column:
    """Array of |S|! times the Hart-Mas-Colell potential of every coalition S, whole numbers.

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, P of the empty coalition is 0; times |S|!
    that is (|S|-1)! v(S) plus the scaled potentials of the coalitions with one filter less.
    """
    fact = F.array(*[F.lit(factorial(i)).cast("long") for i in range(filters + 1)])

    def grown(known: Column, s: Column) -> Column:
        less = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s.bitwiseXOR(F.lit(1 << i)))).otherwise(
            F.lit(0).cast("long")) for i in range(filters)), F.lit(0).cast("long"))
        return F.concat(known, F.array(F.get(fact, F.bit_count(s) - 1) * F.get(removed, s) + less))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), grown)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, copies: str = "E",
                 id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What every order of the filters removes at every step, and each filter's Shapley value.

    ``filters`` maps a letter to a failure condition on ``text`` (default A to D); ``copies`` names the
    exact-copy filter, which looks at the whole table. Documents are counted by the set of filters
    they fail; the removal game v(S) of each part, for all, good and toxic documents, follows for
    every coalition. A step that adds filter i to the coalition S removes v(S with i) - v(S). The
    Shapley value is the grand coalition's potential minus that without the filter, here
    times the number of orders, so a whole number.

    Returns part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley: for each part all orders and steps, zeros included. Cases: null texts are empty; a null part
    is the empty string; a row without id comes after all others (it fails E if another id has its text);
    rows of one id and text don't make each other copies; a document with several label rows is good or
    toxic if one of them says so; labels without a document are ignored; texts of any length are one
    row and leave the scan as a digest; an empty table gives no rows; other columns are ignored.
    """
    filters = text_filters() if filters is None else dict(filters)
    names = [*filters, copies]
    k = len(names)
    if k > MOST_FILTERS or len(set(names)) < k or any(len(x) != 1 for x in names):
        raise ValueError(f"filters need different names of one letter, {MOST_FILTERS} at most")
    full = (1 << k) - 1
    every = games(failures(docs, labels, filters, id_col, text_col, part_col), k).withColumn(
        "potential", potentials(F.col("removed_n"), k))
    steps = [(("".join(names[i] for i in order)), at + 1, i, sum(1 << j for j in order[:at]))
             for order in permutations(range(k)) for at, i in enumerate(order)]
    plan = docs.sparkSession.createDataFrame(
        [(steps,)], "steps array<struct<filter_order:string,step:int,i:int,before:int>>")
    # one row of steps: k * k! of them, at most 35,280
    rows = every.join(F.broadcast(plan)).select("*", F.explode("steps").alias("s")).select("*", "s.*")
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("i"))
    v = lambda c, s: F.get(F.col(f"removed_{c}"), s)
    before, after = F.col("before"), F.col("before").bitwiseOR(bit)
    gain = lambda c: v(c, after) - v(c, before)
    rest = F.lit(full).bitwiseXOR(bit)
    return rows.select(
        "part", "filter_order", "step", F.get(F.array(*map(F.lit, names)), F.col("i")).alias("filter"),
        (F.col("total") - v("n", after)).alias("kept"), gain("n").alias("removed"),
        (v("n", bit) - gain("n")).alias("redundant"), (v("n", F.lit(full)) - v("n", rest)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(full)) - k * F.get("potential", rest)).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


# each document against each order and step, without coalitions or potentials
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
lows AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels
          WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
        'A': len(words) < 100,
        'B': 100 * len(list_distinct(words)) < 80 * len(words),
        'C': 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 10 * length(w.text),
        'D': regexp_matches(w.text, '[#$%&*|]'),
        'E': coalesce(low < w.doc_id, w.doc_id IS NULL AND low IS NOT NULL)} AS fails
      FROM w JOIN lows ON lows.text = w.text LEFT JOIN marks ON marks.doc_id = w.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT part, good, toxic, fails,
        (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END)
        || (CASE WHEN fails.C THEN 'C' ELSE '' END) || (CASE WHEN fails.D THEN 'D' ELSE '' END)
        || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS set, count(*) AS n FROM f GROUP BY ALL),
j AS (SELECT part, good, toxic, set, n, filter_order, s.step::INTEGER AS step,
        filter_order[s.step] AS letter,
        contains(set, filter_order[s.step]) AS fails_it,
        regexp_matches(set, '[' || filter_order[1:s.step - 1] || '.]') AS gone
      FROM g, orders, (SELECT unnest(range(1, 6)) AS step) s),
t AS (SELECT part, filter_order, step, letter,
        sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed,
        sum(n) FILTER (gone AND fails_it) AS redundant, sum(n) FILTER (set = letter) AS unique_fails,
        sum(n) FILTER (NOT gone AND fails_it AND good) AS good_lost,
        sum(n) FILTER (NOT gone AND fails_it AND toxic) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM t
"""
