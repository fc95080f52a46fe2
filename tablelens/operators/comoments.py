"""Pairwise-complete correlation of many columns from blocks of co-moments.

The plan doesn't grow with the columns: each task turns its Arrow batches into matrices
and keeps, for every pair (x, y), the count, both means and the three centred sums of
the rows where both have a value, and the bounds of x and y there. Batches are merged by the
usual update of means and centred sums. A task gives one row per pair; the rows of a
pair are merged the same way in Spark, centred on the pair's common mean, so large
offsets cost few digits. Beyond ``BLOCK`` columns twice over, pairs of column blocks
are scanned one by one, so that a task's matrices stay small.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 512  # columns of a block: a scan covers two blocks at most
ROWS = 4096  # rows that become a matrix together

PAIR = {"n": "double", "mx": "double", "my": "double", "sxx": "double", "syy": "double", "sxy": "double",
        "xlo": "double", "xhi": "double", "ylo": "double", "yhi": "double", "wild": "double"}


@dataclass
class CoMoments:
    """Of each pair [i, j], over the rows where both have a value: how i is distributed, and with j.

    Rows with an infinity are counted in ``wild``; their values count as 0 elsewhere.
    """

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wild: np.ndarray

    @classmethod
    def empty(cls, k: int) -> CoMoments:
        zero = lambda: np.zeros((k, k))
        return cls(zero(), zero(), zero(), zero(), np.full((k, k), np.inf), np.full((k, k), -np.inf), zero())

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Of a matrix of rows with NaN for missing values."""
        k = x.shape[1]
        held = ~np.isnan(x)
        wild = np.isinf(x)
        x = np.where(wild, 0.0, x)
        full = held.astype(float)
        n = full.T @ full
        # about a value in the middle, so that no outlier takes the digits of rows without it
        count = held.sum(axis=0)
        centre = np.sort(np.where(held, x, np.inf), axis=0)[np.maximum(count - 1, 0) // 2, np.arange(k)]
        centre = np.where(count > 0, centre, 0.0)
        y = np.where(held, x - centre, 0.0)
        some = np.maximum(n, 1)
        offset = (y.T @ full) / some
        square = (y * y).T @ full - n * offset * offset
        product = y.T @ y - n * offset * offset.T
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        # columns that are missing in the same rows share their partners' bounds
        patterns, of = np.unique(np.packbits(held, axis=0).T, axis=0, return_inverse=True)
        for p in range(len(patterns)):
            columns = np.flatnonzero(of.ravel() == p)
            rows = held[:, columns[0]]
            if rows.any():
                own = held[rows]
                low[:, columns] = np.where(own, x[rows], np.inf).min(axis=0)[:, None]
                high[:, columns] = np.where(own, x[rows], -np.inf).max(axis=0)[:, None]
        return cls(n, centre[:, None] + offset, np.maximum(square, 0.0), product, low, high, wild.T.astype(float) @ full)

    def add(self, other: CoMoments) -> None:
        n = self.n + other.n
        some = np.maximum(n, 1)
        off = np.where(self.n == 0, 0.0, other.mean - self.mean)
        weight = self.n * other.n / some
        self.square += other.square + off * off * weight
        self.product += other.product + off * off.T * weight
        self.mean = np.where(self.n == 0, other.mean, self.mean + off * other.n / some)
        self.n, self.wild = n, self.wild + other.wild
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """The values of ``PAIR`` for the pairs (i, j)."""
        return [self.n[i, j], self.mean[i, j], self.mean[j, i], self.square[i, j], self.square[j, i], self.product[i, j],
                self.low[i, j], self.high[i, j], self.low[j, i], self.high[j, i], self.wild[i, j] + self.wild[j, i]]


def _scan(df: DataFrame, columns: list[str], places: list[int], first: int, second: int) -> DataFrame:
    """(i, j, PAIR) of each task for columns ``places``: all pairs of one block, or those across two.

    ``first``: how many of the columns are the first block's; ``second``: the others'.
    """
    k = first + second
    if second:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(first), np.arange(first, k), indexing="ij"))
    else:
        i, j = np.triu_indices(k)
    at = np.array(places)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = CoMoments.empty(k)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                x = np.empty((part.num_rows, k))
                for c in range(k):
                    x[:, c] = part.column(c).to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    total.add(CoMoments.of(x))
        # one row per pair even from a task without rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[i], pa.int32()), pa.array(at[j], pa.int32()), *(pa.array(v) for v in total.pairs(i, j))],
            ["i", "j", *PAIR])

    values = df.select(*[as_double(df, c).alias(f"_{n}") for n, c in enumerate(columns)])
    return values.mapInArrow(gather, "i int, j int, " + ", ".join(f"{c} {t}" for c, t in PAIR.items()))


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) for the numbers i <= j of ``columns``: Pearson's r over the rows where both have a value.

    On the diagonal 1. NULL where either column is constant over those rows (or there are fewer than two), and
    where one of them has an infinity there.
    """
    blocks = [list(range(a, min(a + BLOCK, len(columns)))) for a in range(0, len(columns), BLOCK)]
    if len(blocks) <= 2:
        blocks = [[x for b in blocks for x in b]]
    scans = []
    for a, left in enumerate(blocks):
        for b in range(a, len(blocks)):
            right = blocks[b] if b > a else []
            scans.append(_scan(df, [columns[x] for x in left + right], left + right, len(left), len(right)))
    tasks = scans[0]
    for x in scans[1:]:
        tasks = tasks.unionByName(x)
    # one row per task and pair: the common means first, then the sums about them
    pair = Window.partitionBy("i", "j")
    share = lambda c: F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), F.sum("n").over(pair))
    centred = tasks.withColumns({"_x": share("mx"), "_y": share("my")})
    dx, dy = F.col("mx") - F.col("_x"), F.col("my") - F.col("_y")
    held = F.col("n") > 0
    total = lambda e: F.sum(F.when(held, e))
    merged = centred.groupBy("i", "j").agg(
        total(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), total(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        total(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        *[f(c).alias(c) for f, c in ((F.min, "xlo"), (F.max, "xhi"), (F.min, "ylo"), (F.max, "yhi"))],
        F.sum("wild").alias("wild"))
    varied = (F.col("xlo") < F.col("xhi")) & (F.col("ylo") < F.col("yhi")) & (F.col("wild") == 0)
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))
    return merged.select("i", "j", F.nanvl(F.when(varied, r), F.lit(None).cast("double")).alias("r"))
