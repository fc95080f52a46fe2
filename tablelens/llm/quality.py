"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import SPACE, SPACE_CLASS, table

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
BROADCAST_IDS = 200_000  # trusted ids that are broadcast, at most
SHORT_TEXT = 1 << 12
THRESHOLD = -0.11
SMOOTHING = 10.0


def _tail(array: Column, start: int, n: Column) -> Column:
    """The elements from 1-based ``start``, ``n`` of them (none if ``n`` is negative)."""
    return F.slice(array, start, F.greatest(n, F.lit(0)))


def hashed_words(rows: DataFrame) -> DataFrame:
    """Adds n_words, uni (a hash for each word) and bi (one for each pair of neighbours)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")
    return rows.withColumn("uni", F.transform(words, lambda w: F.xxhash64(w))).withColumn(
        "n_words", F.size("uni").cast("long")).withColumn(
        "bi", F.zip_with(_tail(F.col("uni"), 1, F.size("uni") - 1),
                         _tail(F.col("uni"), 2, F.size("uni") - 1), lambda a, b: F.xxhash64(a, b)))


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that occur twice or more in the text.

    Each window is a hash and its position. Sorted, equal hashes are neighbours; the flagged
    positions in order then tell how many words their windows cover. In texts of fewer than
    ``SHORT_TEXT`` words the hash stands above the position in one number, 52 bits or more of it; in
    longer ones, where positions would take bits of the hash, beside it.
    """
    tri = F.zip_with(_tail(F.col("bi"), 1, F.size("bi") - 1), _tail(F.col("uni"), 3, F.size("bi") - 1),
                     lambda a, b: F.xxhash64(a, b))
    low, place = F.lit(SHORT_TEXT - 1).cast("long"), lambda i: i.cast("long")
    short = F.col("n_words") < SHORT_TEXT
    rows = rows.withColumns({
        "_near": F.when(short, F.sort_array(F.transform(
            tri, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(place(i))))),
        "_far": F.when(~short, F.sort_array(F.transform(
            tri, lambda h, i: F.struct(h.alias("h"), place(i).alias("i")))))})

    def twins(windows: str, equal: Callable, at: Callable) -> Column:
        n = F.size(windows)
        pairs = F.filter(F.zip_with(_tail(F.col(windows), 1, n - 1), _tail(F.col(windows), 2, n - 1),
                                    lambda a, b: F.when(equal(a, b), F.array(at(a), at(b)))), lambda x: x.isNotNull())
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    rows = rows.withColumn("_at", F.when(short, twins(
        "_near", lambda a, b: a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0, lambda x: x.bitwiseAND(low))).otherwise(
        twins("_far", lambda a, b: a["h"] == b["h"], lambda x: x["i"])))
    covered = F.zip_with("_at", _tail(F.col("_at"), 2, F.size("_at")),
                         lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return rows.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda x, y: x + y)
    ).drop("_near", "_far", "_at")


def target_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of all trusted documents; broadcast if they are few enough by count, else joined as they are."""
    ids = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("_target")).where(
        F.col("_target").isNotNull()).distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def log_ratios(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array ``weights``: 1e6 * log(p_target / p_raw) for each bucket, rounded to
    whole numbers, so that sums don't depend on their order.

    Both multinomials are smoothed by the raw one: a bucket gets ``SMOOTHING`` more target
    n-grams as expected, which draws the ratios of rare buckets to 1.

    The raw multinomial counts the n-grams of all documents, the target one those
    of the trusted documents. Both are summed map-side, so at most ``buckets`` rows
    a task are shuffled. Without any trusted n-gram all weights are 0.
    """
    grams = hashed_words(docs).join(
        targets, F.col("doc_id") == F.col("_target"), "left").select(
        F.col("_target").isNotNull().cast("long").alias("hit"),
        F.explode(F.transform(F.concat("uni", "bi"), lambda h: h.bitwiseAND(buckets - 1))).alias("bucket"))
    found = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target"))
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("bucket")).join(
        found, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    packed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b"),
                       F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    expected = lambda x: x["raw"] * F.col("all_target") / F.col("all_raw")
    ratio = lambda x: F.round(1e6 * F.log(
        (x["target"] + SMOOTHING) / (expected(x) + SMOOTHING))).cast("long")
    return packed.select(F.transform("b", lambda x: F.when(
        F.col("all_target") > 0, ratio(x)).otherwise(F.lit(0).cast("long"))).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  buckets: int = BUCKETS, min_words: int = 50,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every whole text by base counts and by how much it resembles trusted texts.

    The score is the mean of log(p_target / p_raw) over all hashed word unigrams
    and bigrams of the text; a text passes if it isn't below ``threshold``. The
    raw multinomial covers all documents, the target one all that ``labels`` calls good.

    Returns ``row`` (a struct of all columns of ``docs``), doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed and kept, one row per input row.
    Cases: null and empty texts have no words, score 0, and fail the base rule; null
    ids are judged but are never trusted; repeated rows are judged alike; without
    trusted documents every score is 0; an empty table gives no rows; other columns
    only pass through in ``row``.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.struct("*").alias("row"))
    # the model, ``buckets`` numbers, as one constant array (folded once, read by index)
    model = log_ratios(rows.drop("row"), target_ids(labels), buckets).first()["weights"]
    weights = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    add = lambda total, h: total + weights[h.bitwiseAND(buckets - 1).cast("int")]
    zero = F.lit(0).cast("long")
    counted = repeated_words(hashed_words(rows).withColumn("_lines", lines)).select(
        "row", "doc_id", "n_words", F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.aggregate("uni", zero, add) + F.aggregate("bi", zero, add))
         / (1e6 * F.greatest(F.size("uni") + F.size("bi"), F.lit(1)))).alias("score"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # always true, but not to Catalyst: a filter on ``kept`` is not pushed down, which would
    # repeat the expressions above at every step of the plan
    here = F.monotonically_increasing_id() >= 0
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold) & here)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "score")
