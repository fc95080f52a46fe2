import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tablelens.functions.dates import DATETIME_FORMATS, parse_datetime
from tablelens.operators import analysis as A


def approx(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


@pytest.fixture
def five(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (5.0,)], "a double")


def test_missing_values_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (float("nan"), "y")], "v double, s string")
    got = dict((r.column_name, r.missing) for r in A.missing_values(df).collect())
    assert got == {"v": 2, "s": 1}


def test_describe_numeric_values(five):
    got = {r.stat: r.value for r in A.describe_numeric(five).collect()}
    want = {"count": 4, "mean": 2.75, "std": 1.7078251276599330, "min": 1, "25%": 1.75,
            "50%": 2.5, "75%": 3.5, "max": 5}
    for k, v in want.items():
        assert approx(got[k], v), k


def test_describe_single_row_has_null_std(spark):
    df = spark.createDataFrame([(7.0,)], "a double")
    got = {r.stat: r.value for r in A.describe_numeric(df).collect()}
    assert got["std"] is None and got["mean"] == 7.0


def test_describe_only_text_falls_back_to_categorical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "s string")
    got = {r.stat: r.value for r in A.describe_numeric(df, ["s"]).collect()}
    assert got == {"count": "5", "unique": "3", "top": "a", "freq": "2"}


def test_describe_no_numeric_message(spark):
    df = spark.createDataFrame([("x",)], "s string")
    assert A.describe_numeric(df).columns == ["message"]


def test_value_counts_ties_and_bounds(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacd"] + [(None,)], "s string")
    got = [tuple(r) for r in A.value_counts(df, "s", 2).collect()]
    assert got == [("a", 2), ("b", 2)]
    assert A.value_counts(df, "s", 500).count() == 4
    many = spark.range(300).select(F.col("id").cast("string").alias("s"))
    assert A.value_counts(many, "s", 200).count() == 200  # as many as asked for
    with pytest.raises(ValueError):
        A.value_counts(df, "s", 0)
    assert A.value_counts(df, "nope").columns == ["message"]


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, None, 7.0),
                                (None, 1.0, 7.0), (5.0, 9.0, 7.0)], "a double, b double, k double")
    got = {(r.x, r.y): r.r for r in A.correlation_matrix(df).collect()}
    assert approx(got[("a", "b")], 0.9992600812897368)
    assert got[("a", "b")] == got[("b", "a")]
    assert got[("a", "k")] is None and got[("k", "k")] is None
    assert got[("a", "a")] == 1.0


def test_correlation_needs_two_columns(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert A.correlation_matrix(df).columns == ["message"]


def test_groupby_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 2.0)],
                               "k string, v double")
    res = {agg: {r[0]: r[1] for r in A.groupby_agg(df, "k", "v", agg).collect()}
           for agg in A.GROUP_AGGS}
    assert res["sum"] == {"a": 0.0, "b": 1.0}
    assert res["count"] == {"a": 0, "b": 1}
    for agg in ("mean", "min", "max", "median"):
        assert res[agg] == {"a": None, "b": 1.0}
    assert set(res["mean"]) == {"a", "b"}  # null key dropped


def test_groupby_guards(spark):
    df = spark.createDataFrame([("a", "x")], "k string, v string")
    assert A.groupby_agg(df, "k; drop", "v").columns == ["message"]
    assert A.groupby_agg(df, "k", "missing").columns == ["message"]
    with pytest.raises(ValueError):
        A.groupby_agg(df, "k", "v", "mean")
    assert A.groupby_agg(df, "k", "v", "max").count() == 1
    with pytest.raises(ValueError):  # an unknown aggregate means mean
        A.groupby_agg(df, "k", "v", "bogus")


def test_anomaly_detection(spark):
    vals = [10.0] * 20 + [100.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    r = A.anomaly_detection(df, "x", 3.0).collect()[0]
    assert r["count"] == 1 and r["max_anomaly"] == 100.0 and r["std_anomaly"] is None
    assert r["percentage"] == round(100 / 22, 2)
    assert r["message"] is None


def test_anomaly_constant_and_single(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    r = A.anomaly_detection(df, "x").collect()[0]
    assert r["count"] is None and r["message"].startswith("Insufficient variance")
    one = spark.createDataFrame([(3.0,)], "x double")
    assert A.anomaly_detection(one, "x").collect()[0]["message"] is not None
    txt = spark.createDataFrame([("a",)], "x string")
    assert A.anomaly_detection(txt, "x").columns == ["message"]


TREND_TS = [dt.datetime(2024, 1, 7, 15), dt.datetime(2024, 1, 8), dt.datetime(2024, 2, 29, 23, 59),
            dt.datetime(2024, 5, 1), dt.datetime(2025, 3, 3)]


@pytest.mark.parametrize("freq,labels", [
    ("M", ["2024-01-31", "2024-02-29", "2024-05-31", "2025-03-31"]),
    ("W", ["2024-01-07", "2024-01-14", "2024-03-03", "2024-05-05", "2025-03-09"]),
    ("Q", ["2024-03-31", "2024-06-30", "2025-03-31"]),
    ("Y", ["2024-12-31", "2025-12-31"]),
    ("D", ["2024-01-07", "2024-01-08", "2024-02-29", "2024-05-01", "2025-03-03"]),
    ("bogus", ["2024-01-31", "2024-02-29", "2024-05-31", "2025-03-31"]),
])
def test_trend_labels(spark, freq, labels):
    df = spark.createDataFrame([(t, float(i + 1)) for i, t in enumerate(TREND_TS)],
                               "d timestamp_ntz, v double")
    got = sorted(r.period.date().isoformat() for r in A.time_series_trend(df, "d", "v", freq).collect())
    assert got == labels


def test_trend_parses_text_and_drops_bad(spark):
    df = spark.createDataFrame([("2024-01-05", "1.5"), ("not a date", "2"), ("2024-01-20", "x"),
                                ("2024-01-25", "2.5")], "d string, v string")
    got = A.time_series_trend(df, "d", "v", "M").collect()
    assert len(got) == 1 and got[0]["mean"] == 2.0


def test_infinities_are_no_anomalies(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),)], "x double")
    r = A.anomaly_detection(df, "x").first()
    assert r["count"] is None and r.message.startswith("Insufficient variance")
    two = df.withColumn("y", F.col("x") * 2)
    assert {(c.x, c.y): c.r for c in A.correlation_matrix(two).collect()} == {
        (a, b): None for a in "xy" for b in "xy"}


def test_nan_is_no_group(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (None, 4.0)], "k double, v double")
    assert [tuple(r) for r in A.groupby_agg(df, "k", "v", "mean").collect()] == [(1.0, 2.0)]


def test_trend_of_dates_that_are_not_iso(spark):
    df = spark.createDataFrame([("01/15/2024", 1.0), ("01/20/2024", 3.0), ("02/01/2024", 5.0), ("junk", 9.0)],
                               "d string, v double")
    got = sorted(tuple(r) for r in A.time_series_trend(df, "d", "v").collect())
    assert got == [(dt.datetime(2024, 1, 31), 2.0), (dt.datetime(2024, 2, 29), 5.0)]


def test_describe_names_empty_text_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "s string, e string")
    got = {(r.column_name, r.stat): r.value for r in A.describe_categorical(df, ["s", "e"]).collect()}
    assert got["e", "count"] == "0" and got["e", "top"] is None and got["s", "freq"] == "2"


def test_text_dates_are_parsed_only_under_formats_of_their_shape(spark):
    """Each format reads what Spark's parser reads under it; texts of other shapes don't get to the parser."""
    rng = random.Random(5)
    texts = ["2024-02-30", "1999/12/31 23:59:59", "1999/12/31", "12345/01/02", "+12345/01/02", "-1999/01/02", "+1999/01/02", "99/01/02", "1999/1/2", "02/30/2020",
             "02/29/2020", "02/29/2021", "3/5/1999", "0003/005/1999", "+3/5/1999", "-3/5/1999", "13/01/1999", "00/10/1999", "03/05/1999 24:00",
             "03/05/1999 23:59", "03/05/1999 23:59:60", "03/05/1999 23:59:59", "31-12-1999", "31.12.1999", "31.12.1999 ", "19991231", "+123451231",
             "123451231", "-19991231", "5 Mar 1999", "05 mar 1999", "5 March 1999", "Mar 5, 1999", "MAR 05, 1999", "Sept 5, 1999", "ſep 5, 1999",
             "September 5, 1999", "may 5, 1999", "May  5, 1999", "Jan 31,1999", "03/05/1999\n", "٣/5/1999", "٣1/12/1999", "", " ", "x" * 300,
             "0" * 25 + "3/5/1999", "3/5/" + "0" * 15 + "1999", "3/5/" + "0" * 25 + "1999", "0" * 18 + "3/" + "0" * 18 + "5/" + "0" * 15 + "1999",
             "September " + "0" * 18 + "5, +" + "0" * 15 + "1999", None]
    texts += [t[:i] + rng.choice("0123456789/-.:, +aM\n") + t[i + rng.randrange(2):] for t in texts[:39] for i in [rng.randrange(len(t)) for _ in range(12)]]
    df = spark.createDataFrame([(t,) for t in texts], "d string").repartition(1)
    for fmt in DATETIME_FORMATS[1:]:
        guarded = parse_datetime(F.col("d"), fmt)
        plain = F.try_to_timestamp("d", F.lit(fmt)).cast("timestamp_ntz")
        rows = df.select("d", guarded.cast("string").alias("got"), plain.cast("string").alias("want")).collect()  # years over 9999, too
        assert [r.d for r in rows if r.got != r.want] == [], fmt
        assert any(r.got for r in rows) and "RLIKE" in df.select(guarded)._jdf.queryExecution().optimizedPlan().toString(), fmt
    odd = F.try_to_timestamp("d", F.lit("yyyy-MM-dd'T'HH")).cast("timestamp_ntz")  # parts without a known shape: as before
    assert str(parse_datetime(F.col("d"), "yyyy-MM-dd'T'HH")) == str(odd)
