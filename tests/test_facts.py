import datetime as dt
import math
import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tablelens.operators import analysis as A
from tablelens.operators import charts as V
from tablelens.operators import profile as P
from tablelens.operators.facts import Facts
from tablelens.plans import plan as W


def table(spark, rows=300):
    rng = random.Random(5)
    return spark.createDataFrame(
        [(10 ** 6 + i, rng.choice([None, float("nan"), rng.gauss(0, 1), 1e3]), rng.choice(["a", "b", None, "c"]), i % 3 == 0, None,
          dt.datetime(2024, 1 + i % 12, 1), f"2024-{1 + i % 12:02}-03", 7.5, None if i % 5 else float("inf")) for i in range(rows)],
        "k bigint, v double, s string, flag boolean, none double, t timestamp_ntz, day string, same double, far double")


def equal(got, want):
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    a, b = (sorted((tuple(r) for r in x.collect()), key=repr) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or isinstance(p, float) and isinstance(q, float) and (
                math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-12) or math.isnan(p) and math.isnan(q)), (x, y)


def test_facts_give_the_operators_results(spark):
    df = table(spark)
    f = Facts(df)
    equal(f.profile(), P.profile(df))
    equal(f.missing_values(), A.missing_values(df))
    equal(f.correlation_matrix(), A.correlation_matrix(df))
    equal(f.describe_numeric(["v", "k"]), A.describe_numeric(df, ["v", "k"]))
    assert f.describe_numeric(["s"]) is None and f.correlation_matrix(["k", "v"]) is None
    equal(f.value_counts("s", 2), A.value_counts(df, "s", 2))
    assert f.value_counts("k") is None and f.value_counts("s", 0) is None
    for c in ("v", "none", "same"):
        equal(f.anomaly_detection(c, 0.5), A.anomaly_detection(df, c, 0.5))
        equal(f.histogram(c, 7), V.histogram(df, c, 7))
    equal(f.histogram("far"), V.histogram(df, "far"))
    equal(f.box_plot("v"), V.box_plot(df, "v"))
    assert f.histogram("s") is None and f.box_plot("nothing") is None and f.step("groupby_agg", {}) is None


def test_facts_of_an_empty_table(spark):
    df = table(spark).limit(0)
    f = Facts(df)
    equal(f.missing_values(), A.missing_values(df))
    equal(f.correlation_matrix(), A.correlation_matrix(df))
    equal(f.anomaly_detection("v"), A.anomaly_detection(df, "v"))
    equal(f.histogram("v"), V.histogram(df, "v"))
    equal(f.box_plot("v"), V.box_plot(df, "v"))


def test_a_report_reads_the_table_five_times(spark, tmp_path):
    """Each read of the one-partition table leaves a file."""
    seen = str(tmp_path)

    def note(batches):
        import uuid

        open(os.path.join(seen, uuid.uuid4().hex), "w").close()
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)

    source = table(spark).select("k", "v", "s", "t", "day", "same").coalesce(1)
    df = source.mapInArrow(note, source.schema)
    res = W.analyze(df)
    assert not any(isinstance(v, str) for v in res.values()), res
    assert {"profile", "chart_histogram_numeric", "chart_box_numeric", "chart_bar_category", "chart_correlation_heatmap",
            "chart_anomaly_summary", "chart_line_timeseries"} <= set(res)
    assert len(os.listdir(seen)) <= 5
    plain = W.run_plan(source, W.default_plan(W.column_classes(source)))
    assert set(plain) == {k for k in res if k.startswith("step_")}
    for k, v in plain.items():
        equal(res[k], v)
    equal(res["chart_line_timeseries"], V.trend_line(source, "t", "k", "M"))
    equal(res["chart_correlation_heatmap"].where(F.col("x") != ""), V.heatmap(source))


def test_two_columns_of_one_name_leave_messages(spark):
    df = spark.range(5).select(F.col("id").alias("a"), (F.col("id") * 2).alias("a"))
    assert W.gathered(df) is None


def test_wide_tables_are_taken_as_rows(spark, monkeypatch):
    df = table(spark)
    stats, describe = P.column_stats(df), A.describe_numeric(df, ["v", "k", "same"])
    for m in (A, P):
        monkeypatch.setattr(m, "WIDE", 2)
    equal(P.column_stats(df), stats)
    equal(A.describe_numeric(df, ["v", "k", "same"]), describe)
    none = P.column_stats(df.limit(0)).collect()
    assert len(none) == 9 and {(r.n_rows, r.num_missing) for r in none} == {(0, 0)}
    approx = {r.column_name: r.approx_unique for r in P._stats_frame(df, True).collect()}
    assert approx["s"] == 3 and approx["none"] == 0
