import datetime as dt
from decimal import Decimal

from tablelens.operators import profile as P


def by_col(df):
    return {r.column_name: r for r in df.collect()}


def test_numeric(spark):
    df = spark.createDataFrame([(25, 50000), (30, 60000), (35, 70000)], "age int, salary int")
    p = by_col(P.profile(df))
    assert p["age"]["class"] == "numeric" and p["age"]["mean"] == 30.0
    assert p["age"]["num_rows"] == 3 and p["age"]["num_cols"] == 2
    assert p["salary"]["median"] == 60000.0 and p["salary"]["variance"] == 1e8


def test_categorical_top_values(spark):
    df = spark.createDataFrame([("red",), ("blue",), ("red",), ("green",)], "color string")
    p = by_col(P.profile(df))["color"]
    assert p["class"] == "categorical" and p["num_unique"] == 3
    assert [(t.value, t["count"]) for t in p["top_values"]] == [("red", 2), ("blue", 1), ("green", 1)]


def test_timestamp_and_text_dates(spark):
    ts = [dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 15), dt.datetime(2024, 12, 31)]
    df = spark.createDataFrame([(t, t.strftime("%Y-%m-%d")) for t in ts],
                               "date timestamp_ntz, date_str string")
    p = by_col(P.profile(df))
    assert p["date"]["class"] == "datetime"
    assert p["date"]["datetime_min"] == ts[0] and p["date"]["datetime_max"] == ts[-1]
    assert p["date_str"]["class"] == "datetime_like" and p["date_str"]["datetime_ratio"] == 1.0
    assert p["date_str"]["top_values"] is None


def test_text_dates_other_format_and_threshold(spark):
    vals = ["01/31/2024", "02/15/2024", "03/01/2024", "04/30/2024", "junk"]
    p = by_col(P.profile(spark.createDataFrame([(v,) for v in vals], "d string")))["d"]
    assert p["class"] == "datetime_like" and p["datetime_format"] == "MM/dd/yyyy"
    vals2 = ["2024-01-01", "x", "y"]
    p2 = by_col(P.profile(spark.createDataFrame([(v,) for v in vals2], "d string")))["d"]
    assert p2["class"] == "categorical"


def test_missing_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,), (5.0,), (float("nan"),)], "val double")
    p = by_col(P.profile(df))["val"]
    assert p["num_missing"] == 3 and p["num_unique"] == 3 and p["mean"] == 3.0


def test_empty(spark):
    df = spark.createDataFrame([], "a double")
    p = by_col(P.profile(df))["a"]
    assert p["num_rows"] == 0 and p["num_missing"] == 0 and p["mean"] is None


def test_mixed_classes(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)],
                               "id int, name string, score double")
    classes = {r.column_name: r["class"] for r in P.classes(df).collect()}
    assert classes == {"id": "numeric", "name": "categorical", "score": "numeric"}
    p = by_col(P.profile(df))
    assert {k: v["class"] for k, v in p.items()} == classes


def test_single_row_constant(spark):
    df = spark.createDataFrame([(4.0,)], "a double")
    p = by_col(P.profile(df))["a"]
    assert p["variance"] is None and p["median"] == 4.0


def test_top_values_frame(spark):
    df = spark.createDataFrame([(v,) for v in "aabbbcdefg"], "s string")
    got = [tuple(r) for r in P.top_values(df, 3).orderBy("rank").collect()]
    assert got == [("s", 1, "b", 3), ("s", 2, "a", 2), ("s", 3, "c", 1)]


def test_values_that_doubles_confuse_are_distinct(spark):
    big = 2 ** 53
    df = spark.createDataFrame(
        [(big + i, Decimal(f"90071992547409.{92 + i % 3}"), Decimal(f"{10 ** 25 + i}.5"), dt.datetime(2024, 1, 1, microsecond=i % 2),
          dt.date(2024, 1, 1 + i), -0.0 if i % 2 else 0.0, 0.1, bool(i % 2), f"t{i // 2}") for i in range(6)]
        + [(None,) * 9],
        "k bigint, d decimal(16,2), w decimal(38,1), ts timestamp_ntz, day date, z double, f float, b boolean, s string")
    want = {"k": 6, "d": 3, "w": 6, "ts": 2, "day": 6, "z": 1, "f": 1, "b": 2, "s": 3}
    assert {r.column_name: r.num_unique for r in P.unique_counts(df).collect()} == want
    p = by_col(P.profile(df))
    assert {c: r.num_unique for c, r in p.items()} == want
    assert p["k"]["median"] == float(big + 4) and p["w"]["median"] == 1e25 and p["b"]["median"] == 0.5
    empty = by_col(P.profile(df.limit(0)))
    assert {r.num_unique for r in empty.values()} == {0} and {r.median for r in empty.values()} == {None}
    assert {r.num_unique for r in P.unique_counts(df.limit(0)).collect()} == {0}


def test_nested_columns_have_no_distinct_count(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1})], "i int, a array<int>, m map<string,int>")
    assert {r.column_name: r.num_unique for r in P.unique_counts(df).collect()} == {"i": 1, "a": None, "m": None}
    assert by_col(P.profile(df))["a"]["num_unique"] is None


def test_profile_reads_the_table_three_times(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id * 0.37 AS x", "CAST(id % 10 AS STRING) AS s", "timestamp_micros(id) AS t",
                                      "CAST(id AS DECIMAL(12,2)) AS d")
    df.write.parquet(str(tmp_path / "t"))
    p = P.profile(spark.read.parquet(str(tmp_path / "t")))
    p.collect()
    assert p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") <= 4
