"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    rows = entry.entry(spark).groupBy("result").count().collect()
    count = {r["result"]: r["count"] for r in rows}
    assert count["profile"] == len(spark.read.parquet(f"{SF}/lineitem.parquet").columns)
    assert len(count) >= 12 and not any("error" in x for x in count)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    got = rows_of([tuple(r) for r in sdf.collect()], sdf.columns)
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    want = rows_of(res.fetchall(), cols)
    assert sorted(sdf.columns) == sorted(cols)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9), (name, a, b)
            else:
                assert x == y, (name, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
