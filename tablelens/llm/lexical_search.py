"""Ranked lexical search: summed accumulators of short lists inside document-at-a-time skipping."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import reaching, table, text_batches, written

TOP = 10
BLOCK_ROWS = 8192  # documents of an index block, at most
QUERY_BYTES = 8 << 20  # text of the queries that one pass over the index answers
SHORT = 32  # a list is short if it holds fewer than one document in so many
WINDOW = 1024  # documents that are looked at together

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def terms(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits and all other characters, only A-Z in lower case."""
    return _TERM.findall((text or "").translate(_LOWER))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight gets from ``tf`` occurrences in a document of measure ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """Postings of one block: places (ascending) and counts of each term, lengths of all documents."""

    def __init__(self, n: np.ndarray, term: np.ndarray, start: np.ndarray, place: np.ndarray, tf: np.ndarray):
        self.n, self.rows = n.astype(np.int64), len(n)
        self.at = {t: (a, b) for t, a, b in zip(term.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True)}
        self.place, self.tf = place.astype(np.int64), tf.astype(np.int64)

    def weighted(self, weights: dict[int, int], m: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
        """For each term with a weight its places, its scores there and the highest of them."""
        lists = {}
        for t, (a, b) in self.at.items():
            if (w := weights.get(t, 0)) > 0:
                scores = w * parts(self.tf[a:b], m[self.place[a:b]])
                lists[t] = (self.place[a:b], scores, int(scores.max()))
        return lists


def accumulated(lists: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Term at a time: the lists as one, with the summed scores of each place."""
    places = np.concatenate([x[0] for x in lists])
    scores = np.concatenate([x[1] for x in lists])
    order = np.argsort(places, kind="stable")
    places, scores = places[order], scores[order]
    begins = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    sums = np.add.reduceat(scores, begins)
    return places[begins], sums, int(sums.max())


def best(lists: list[tuple[np.ndarray, np.ndarray, int]], rows: int, top: int, short: int = SHORT,
         window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` best documents of a block, equal scores by place.

    The short lists become accumulators, summed term at a time, and these one bounded
    iterator beside the long lists. Documents then come in order of their places, a
    window at a time: iterators whose bounds together stay below the top-th best score so far
    propose none (a document only they hold can't get in); the others' documents are the
    candidates, and each list that proposes none is skipped to those candidates that can
    still reach that score with the bounds of the lists left.
    """
    limit = max(1, rows // short)
    few = [x for x in lists if len(x[0]) < limit]
    iters = [x for x in lists if len(x[0]) >= limit]
    floor = 0
    if few:
        summed = accumulated(few)
        iters.append(summed)
        if len(summed[1]) >= top:  # a sum is the least its document can score
            floor = int(np.partition(summed[1], -top)[-top])
    iters.sort(key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in iters])
    held_at, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = [0] * len(iters)
    first = 0
    while first < len(iters) and bounds[first] < floor:
        first += 1
    while first < len(iters):
        # skip to the next document that an essential iterator holds
        heads = [int(x[0][i]) for x, i in zip(iters[first:], at[first:], strict=True) if i < len(x[0])]
        if not heads:
            break
        begin = min(heads)
        end = begin + window
        sums = np.zeros(window, np.int64)
        for j in range(first, len(iters)):
            places, scores, _ = iters[j]
            stop = at[j] + int(np.searchsorted(places[at[j]:at[j] + window], end))
            sums[places[at[j]:stop] - begin] += scores[at[j]:stop]
            at[j] = stop
        found = np.flatnonzero(sums)
        sums, found = sums[found], found + begin
        for j in range(first - 1, -1, -1):
            may = sums + bounds[j] >= max(floor, 1)
            sums, found = sums[may], found[may]
            if not len(found):
                break
            places, scores, _ = iters[j]
            to = np.searchsorted(places, found)
            hit = np.flatnonzero(places[np.minimum(to, len(places) - 1)] == found)
            sums[hit] += scores[to[hit]]
        may = sums >= floor
        if may.any():
            held_at, held = np.concatenate([held_at, found[may]]), np.concatenate([held, sums[may]])
            if len(held) > top:
                order = np.lexsort((held_at, -held))[:top]
                held_at, held = held_at[order], held[order]
            if len(held) == top and int(held.min()) > floor:
                floor = int(held.min())
                while first < len(iters) and bounds[first] < floor:
                    first += 1
    order = np.lexsort((held_at, -held))[:top]
    return held_at[order], held[order]


def index(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """One row per block of documents: their ids and lengths, and the postings of the vocabulary's terms.

    A block's documents are sorted by id (nulls last); n_docs and n_terms count its documents
    with a term and all their terms, df the documents of each term.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def packed(ids: list[pa.Array], ns: list[int], places: list[int], found: list[int], tfs: list[int]):
        joined = pa.concat_arrays(ids)
        order = pc.sort_indices(joined, null_placement="at_end").to_numpy().astype(np.int64)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        place, term = rank[np.array(places, np.int64)], np.array(found, np.int64)
        by = np.lexsort((place, term))
        place, term, tf = place[by], term[by], np.array(tfs, np.int64)[by]
        names, start = np.unique(term, return_index=True)
        start = np.append(start, len(term))
        n = np.array(ns, np.int64)[order]
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        many = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [many(joined.take(pa.array(order))), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]),
             many(pa.array(names, pa.int32())), many(pa.array(np.diff(start), pa.int32())),
             one(n.astype("<i4")), one(place.astype("<u2")), one(tf.astype("<i4"))],
            ["ids", "n_docs", "n_terms", "term", "df", "n", "place", "tf"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ns, places, found, tfs = [], [], [], [], []
        known = vocabulary.get
        for batch in text_batches(batches):
            for a in range(0, batch.num_rows, 1024):
                piece = batch.slice(a, 1024)
                if len(ns) + piece.num_rows > block_rows and ns:
                    yield packed(ids, ns, places, found, tfs)
                    ids, ns, places, found, tfs = [], [], [], [], []
                ids.append(piece.column("doc_id"))
                for text in piece.column("text").to_pylist():
                    words = terms(text)
                    count = Counter(filter(None, map(known, words)))
                    found.extend(count)
                    tfs.extend(count.values())
                    places.extend([len(ns)] * len(count))
                    ns.append(len(words))
        if ns:
            yield packed(ids, ns, places, found, tfs)

    return reaching(rows).mapInArrow(
        cut, f"ids array<{kind}>, n_docs long, n_terms long, term array<int>, df array<int>, n binary, "
             "place binary, tf binary")


def _ranked(docs: DataFrame, items: list[tuple[object, str]], top: int, id_col: str, text_col: str, item_type: str,
            block_rows: int) -> DataFrame:
    """The ``top`` documents for each of a bounded list of items."""
    spark = docs.sparkSession
    wanted = [sorted(set(terms(text))) for _, text in items]
    vocabulary = {t: i + 1 for i, t in enumerate(sorted({t for x in wanted for t in x}))}
    queries = [[vocabulary[t] for t in x] for x in wanted]
    blocks = written(index(docs, vocabulary, id_col, text_col, block_rows), "lexical-index")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counts = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(
        F.sum("x.df").alias("df"))  # one row for each term of the items at most
    weights = {t: weight(n_docs, df) for t, df in counts.toLocalIterator()}
    kind = docs.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("ids", "term", "df", "n", "place", "tf")}
                raw = lambda c, t: np.frombuffer(row[c].as_py(), dtype=t)
                block = Block(raw("n", "<i4"), row["term"].values.to_numpy(), np.append(0, np.cumsum(
                    row["df"].values.to_numpy())), raw("place", "<u2"), raw("tf", "<i4"))
                m = 10 + 90 * block.n * n_docs // max(n_terms, 1)
                lists = block.weighted(weights, m)
                which, places, scores = [], [], []
                for q, query in enumerate(queries):
                    if mine := [lists[t] for t in query if t in lists]:
                        at, score = best(mine, block.rows, top)
                        which += [q] * len(at)
                        places.append(at)
                        scores.append(score)
                if which:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which, pa.int32()), row["ids"].values.take(pa.array(np.concatenate(places))),
                         pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])

    found = reaching(blocks).mapInArrow(search, f"query int, doc_id {kind}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"_query int, item_id {item_type}")
    return ranked.join(names, F.col("query") == F.col("_query")).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", query_col: str = "text", block_rows: int = BLOCK_ROWS,
                   query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` documents of every query by a weighted sum over its distinct terms.

    A term in df of N documents weighs floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms (L in
    all documents) gets weight * (10^9 tf div (1000 tf + 8m)) for tf occurrences, with m = 10 + 90nN div L.
    Documents are indexed in blocks of at most ``block_rows``, in whichever task reads them, so no list of
    a frequent term meets in one task. Each block answers all queries by ``best``; its ``top`` documents a
    query go to a global ranking (limited in each task first). Queries are taken in lots of
    ``query_bytes`` of text, each with an index of its own terms.

    Returns item_id, rank (from 1), doc_id, score; only scores above 0, equal ones by ascending doc_id, a
    null id last. Cases: null and empty texts have no terms and are not found; a query without terms, or
    with only unknown ones, has no rows; each row of ``queries`` is answered by itself, a repeated one
    again, a null item_id too; repeated documents are ranked one by one; a very long text is one
    document; empty tables give no rows; other columns are ignored.
    """
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block holds 1 to 65,536 documents")
    kind = queries.schema[item_col].dataType.simpleString()
    result, lot, held = None, [], 0

    def add(lot):
        made = _ranked(docs, lot, top, id_col, text_col, kind, block_rows)
        return made if result is None else result.unionByName(made)

    texts = queries.select(F.col(f"`{item_col}`"), F.coalesce(F.col(f"`{query_col}`"), F.lit("")))
    for item, text in texts.toLocalIterator():
        if lot and held + len(text) > query_bytes:
            result, lot, held = add(lot), [], 0
        lot.append((item, text))
        held += len(text)
    if lot or result is None:
        result = add(lot)
    return result


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM len),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_all),
p AS (SELECT item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))
             )::BIGINT AS score
      FROM q JOIN w ON w.term = q.term JOIN tf ON tf.term = q.term JOIN len ON len.doc_id = tf.doc_id, s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
             doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
