"""Plan assertions: the physical plans are the ones the design relies on."""

import datetime as dt

import pytest

from tablelens.operators import analysis as A
from tablelens.operators import charts as V
from tablelens.operators import clean as C
from tablelens.operators import privacy as M
from tablelens.operators import profile as P
from tablelens.operators import retention as RT
from tablelens.operators import text as X
from tablelens.operators.quantiles import column_quantiles

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF")


def plan_of(df):
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_top_values_uses_partial_window_group_limit(spark, lineitem):
    p = plan_of(P.top_values(lineitem.select("l_returnflag", "l_linestatus"), 3))
    assert "WindowGroupLimit" in p


def test_value_counts_is_top_k(lineitem):
    assert "TakeOrderedAndProject" in plan_of(A.value_counts(lineitem, "l_partkey", 10))


def test_rank_items_takes_top_k_before_ranking(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan_of(RT.rank_items(d, "lang", "n_chars", "doc_id", "doc_id"))
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("build", [
    lambda li: P.profile(li),
    lambda li: A.describe_numeric(li),
    lambda li: A.correlation_matrix(li),
    lambda li: A.groupby_agg(li, "l_returnflag", "l_extendedprice", "median"),
    lambda li: A.anomaly_detection(li, "l_extendedprice", 2.0),
    lambda li: A.time_series_trend(li, "l_shipdate", "l_extendedprice", "W"),
    lambda li: V.histogram(li, "l_tax"),
    lambda li: V.box_plot(li, "l_tax"),
    lambda li: C.impute(li, [("l_tax", "impute_median"), ("l_linestatus", "impute_mode")]),
    lambda li: M.mask_table(li.withColumnRenamed("l_extendedprice", "payment")),
])
def test_no_python_workers_outside_html_and_rate(lineitem, build):
    p = plan_of(build(lineitem))
    assert not any(n in p for n in PYTHON_NODES), p[:2000]


def test_html_stays_in_the_jvm(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    p = plan_of(X.sanitize_html(pages, "html"))
    assert "Python" not in p and "InPandas" not in p and "InArrow" not in p and "Exchange" not in p


def test_column_pruning_reaches_scan(lineitem):
    p = plan_of(A.describe_numeric(lineitem, ["l_tax", "l_discount"]))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line]
    assert scans and all("l_orderkey" not in s for s in scans)


def test_exact_quantiles_shuffle_no_input_rows(lineitem):
    """The two scans feed only map-side aggregates (counts per bucket and per
    target-bucket value): every exchange is above a partial aggregate or a
    small broadcast, never directly above the scan's rows."""
    p = plan_of(column_quantiles(lineitem, ["l_extendedprice", "l_tax"], [0.5], "exact"))
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "ReusedExchange" not in line:
            below = "\n".join(lines[i + 1:i + 3])
            assert "HashAggregate" in below or "Window" in below or "Project" in below, below


def test_retention_filter_pushed_down(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    p = plan_of(RT.apply_retention(ev, "ts", 72, now=dt.datetime(2024, 1, 20)))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "PushedFilters" in scan and "ts" in scan.split("PushedFilters")[1][:200]
