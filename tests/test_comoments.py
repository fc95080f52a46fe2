import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import comoments
from tablelens.operators.analysis import FEW_COLUMNS, correlation_matrix


def frame(spark, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x],
                                 ", ".join(f"{c} double" for c in columns)).repartition(5)


def matrix(df):
    return {(r.x, r.y): r.r for r in df.collect()}


def expected(x):
    """Pair by pair from the rows where both have a value; NULL without spread or with an infinity."""
    out = {}
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            both = x[~np.isnan(x[:, i]) & ~np.isnan(x[:, j])][:, [i, j]]
            ok = len(both) > 1 and np.isfinite(both).all() and all(len(set(both[:, c])) > 1 for c in (0, 1))
            out[f"c{i}", f"c{j}"] = None if not ok else 1.0 if i == j else float(np.corrcoef(both.T)[0, 1])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-8)), (k, got[k], v)


@pytest.fixture(scope="module")
def odd_values():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    x[:, 1] = 3 * x[:, 0] + 1e9  # a large offset costs few digits
    x[:, 2] = -x[:, 0] * 1e-12
    x[:, 3] = 5.1  # constant
    x[:, 4] = np.where(rng.random(400) < 0.4, np.nan, x[:, 4] + x[:, 0])
    x[:, 5] = np.where(np.isnan(x[:, 4]), x[:, 5], 0.1)  # constant where column 4 has a value
    x[:, 6] = np.where(rng.random(400) < 0.5, np.nan, 2.0)
    x[:, 7] = np.nan
    x[3, 8], x[4, 9] = np.inf, -np.inf
    x[3, 10] = np.nan  # beside column 8's infinity
    x[:399, 11] = np.nan  # one value only
    x[:, 12] = np.where(rng.random(400) < 0.9, np.nan, x[:, 12])
    x[0, 13] = 1e12  # an outlier far from all others
    return x


def test_pairs_of_odd_columns(spark, odd_values):
    assert odd_values.shape[1] > FEW_COLUMNS
    same(matrix(correlation_matrix(frame(spark, odd_values))), expected(odd_values))


def test_blocks_of_columns(spark, odd_values, monkeypatch):
    monkeypatch.setattr(comoments, "BLOCK", 3)
    monkeypatch.setattr(comoments, "ROWS", 17)
    same(matrix(correlation_matrix(frame(spark, odd_values))), expected(odd_values))


def test_few_columns_give_the_same(spark, odd_values):
    df = frame(spark, odd_values)
    for start in (0, 7):
        names = [f"c{i}" for i in range(start, start + 6)]
        few = matrix(correlation_matrix(df, names))
        wide = matrix(correlation_matrix(df))
        same(few, {k: wide[k] for k in few})


def test_empty_and_typed_columns(spark, odd_values):
    none = matrix(correlation_matrix(frame(spark, odd_values).limit(0)))
    assert len(none) == 256 and set(none.values()) == {None}
    assert set(matrix(correlation_matrix(frame(spark, odd_values).where("c0 > 1e6"))).values()) == {None}
    typed = spark.range(50).select(*[(F.col("id") * (i + 1) % 7).cast(t).alias(f"c{i}") for i, t in enumerate(
        ["tinyint", "smallint", "int", "bigint", "float", "double", "decimal(20,3)", "int", "bigint", "double", "int", "float"])])
    same(matrix(correlation_matrix(typed)), expected(typed.toPandas().astype(float).to_numpy()))


def test_200_columns_stay_one_small_plan(spark):
    wide = spark.range(0, 20_000, 1, 8).select(*[
        F.when(F.xxhash64("id", F.lit(i)) % 10 != 0, F.rand(i) + F.col("id") / 1000 * (i % 3)).alias(f"c{i}") for i in range(200)])
    result = correlation_matrix(wide)
    assert len(result._jdf.queryExecution().executedPlan().toString()) < 200_000
    got = result.toPandas().pivot(index="x", columns="y", values="r")
    want = wide.toPandas().corr()
    order = list(want.columns)
    assert np.allclose(got.loc[order, order].to_numpy(dtype=float), want.to_numpy(), atol=1e-9)
    assert isinstance(want, pd.DataFrame)
