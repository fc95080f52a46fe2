"""The bounded-memory exact quantiles equal Spark's percentile."""

import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import analysis as A
from tablelens.operators.quantiles import column_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    random.seed(3)
    rows = []
    for g, n in enumerate([1, 2, 7, 1000, 3000, 300]):
        for _ in range(n):
            rows.append((g, float(random.choice([1, 2, 2, 3, 1e6, -5.5, 0.0, -1e-300, 1e300,
                                                 random.random() * 100,
                                                 -random.random() * 1e5]))))
    rows += [(9, None), (6, float("inf")), (6, float("-inf")), (6, 1.0)]
    return spark.createDataFrame(rows, "g int, x double")


def close(a, b):
    if a is None or b is None:
        return a is None and (b is None or all(v is None for v in b))
    return all(x == y or abs(x - y) <= 1e-9 * max(1.0, abs(y)) for x, y in zip(a, b))


def reference(df, keys):
    e = F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q")
    out = df.groupBy(*keys).agg(e) if keys else df.agg(e)
    return {tuple(r[k] for k in keys): r.q for r in out.collect()}


@pytest.mark.parametrize("small", [True, False])
def test_grouped_exact_equals_percentile(data, small):
    ref = reference(data, ["g"])
    got = {(r.g,): r.q for r in exact_quantiles(data, ["g"], "x", PROBS, small_keys=small).collect()}
    for k, v in ref.items():
        assert close(got.get(k), v), (k, got.get(k), v)


def test_global_exact_and_empty(data):
    ref = reference(data, [])[()]
    got = exact_quantiles(data, [], "x", PROBS).collect()
    assert len(got) == 1 and close(got[0].q, ref)
    empty = exact_quantiles(data.where("g = 9"), [], "x", PROBS).collect()
    assert len(empty) == 1 and all(v is None for v in empty[0].q)


def test_column_quantiles_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_orderkey"]
    got = {r.column_name: r.q for r in column_quantiles(df, cols, [0.25, 0.5, 0.75], "exact").collect()}
    ref = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
                   .alias(c) for c in cols]).collect()[0]
    assert all(close(got[c], list(ref[c])) for c in cols)


def test_describe_and_median_methods_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = {(r.column_name, r.stat): r.value for r in A.describe_numeric(df, method="exact").collect()}
    b = {(r.column_name, r.stat): r.value for r in A.describe_numeric(df, method="percentile").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-9 * max(1, abs(b[k])) for k in a)
    m1 = {r[0]: r[1] for r in A.groupby_agg(df, "l_returnflag", "l_tax", "median", "exact").collect()}
    m2 = {r[0]: r[1] for r in A.groupby_agg(df, "l_returnflag", "l_tax", "median", "percentile").collect()}
    assert m1 == m2


@pytest.mark.parametrize("far", [1e15, float("inf"), -1e300])
def test_far_values_crowd_no_window(spark, far):
    """One huge value among many must not put all others into one sorted cell."""
    from pyspark.sql import Window

    df = spark.range(0, 50000).select((F.col("id") * 0.37 + 3).alias("x")).union(
        spark.createDataFrame([(far,)], "x double"))
    got = exact_quantiles(df, [], "x", PROBS).collect()[0].q
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS]))).collect()[0][0]
    assert close(got, want)
    # the largest group that any window of the plan sorts
    seen = []
    keep = Window.partitionBy

    def watched(*cols):
        seen.append(cols)
        return keep(*cols)

    Window.partitionBy = staticmethod(watched)
    try:
        exact_quantiles(df, [], "x", PROBS)
    finally:
        Window.partitionBy = staticmethod(keep)
    assert all(cols and cols[-1] == "_at" or not cols for cols in seen)
    from tablelens.operators import quantiles as Q
    low, high = df.where("abs(x) < 1e14").agg(F.min("x"), F.max("x")).first()
    cells = df.where("abs(x) < 1e14").groupBy(Q._magnitude(F.col("x")).alias("m"), Q._equal_width(F.col("x"), F.lit(low), F.lit(high)).alias("c")
                       ).count().agg(F.max("count")).first()[0]
    assert cells <= 50000 / Q.CELLS * 8


def test_integers_and_ties(spark):
    df = spark.createDataFrame([(g, float(v)) for g in range(3) for v in [7] * 500 + [-(2**53)] * 3 + list(range(40))],
                               "g int, x double")
    ref = reference(df, ["g"])
    got = {(r.g,): r.q for r in exact_quantiles(df, ["g"], "x", PROBS).collect()}
    assert all(close(got[k], v) for k, v in ref.items())
