import math
import random
import statistics

from pyspark.sql import functions as F

from tablelens.operators import clean as C


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3.0, None)], "a int, b double, c string")
    got = sorted(tuple(r) for r in C.missing_columns(df).collect())
    assert got == [("b", 1, "double"), ("c", 1, "string")]


def test_drop_and_drop_column(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, float("nan"))], "a int, b double")
    assert [r.a for r in C.drop_rows(df, "b").collect()] == [2]
    assert C.drop_column(df, "b").columns == ["a"]


def test_impute_mean_median_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "b"), (10.0, "a"), (None, None),
                                (None, "c")], "v double, s string")
    mean = sorted(r.v for r in C.impute_mean(df, "v").collect())
    assert mean == sorted([1.0, 3.0, 10.0] + [14.0 / 3] * 3)
    med = sorted(r.v for r in C.impute_median(df, "v").collect())
    assert med == sorted([1.0, 3.0, 10.0, 3.0, 3.0, 3.0])
    # mode tie: a and b both twice -> the smaller, a
    modes = [r.s for r in C.impute_mode(df, "s").collect()]
    assert modes.count("a") == 3 and None not in modes


def test_impute_mean_on_text_is_noop(spark):
    df = spark.createDataFrame([("x",), (None,)], "s string")
    assert sorted(r.s or "" for r in C.impute_mean(df, "s").collect()) == ["", "x"]


def test_impute_mode_all_null_is_noop(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert [r.s for r in C.impute_mode(df, "s").collect()] == [None, None]


def test_plan_order_statistics_after_drop(spark):
    df = spark.createDataFrame([(1, 100.0, None), (2, None, 1.0), (3, 1.0, 2.0), (4, None, 3.0),
                                (5, 3.0, 4.0)], "id int, v double, w double")
    plan = [{"column": "w", "action": "drop"},        # removes id 1 (v=100)
            {"column": "v", "action": "impute_mean"},  # mean of 1, 3 = 2
            {"column": "gone", "action": "drop"},
            {"column": "w", "action": "bogus"},
            {"column": "w", "action": "drop_column"}]
    out = C.apply_cleaning_plan(df, plan)
    assert out.columns == ["id", "v"]
    assert sorted(tuple(r) for r in out.collect()) == [(2, 2.0), (3, 1.0), (4, 2.0), (5, 3.0)]


def test_validate_cleaning_plan():
    steps = [{"column": "a", "action": "drop"}, {"column": "zz", "action": "drop"},
             {"column": "a", "action": "explode"}, "junk"]
    assert C.validate_cleaning_plan(steps, ["a"]) == [{"column": "a", "action": "drop"}]


def test_a_mean_of_text_blocks_no_mode(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, s string")
    plan = [{"column": "s", "action": "impute_mean"}, {"column": "s", "action": "impute_mode"}]
    assert {r.id: r.s for r in C.apply_cleaning_plan(df, plan).collect()}[3] == "a"


def stepwise(rows, columns, types, plan):
    """The plan, step by step, on lists of rows."""
    rows, columns = [dict(zip(columns, r)) for r in rows], list(columns)
    types = dict(zip(columns, types))
    for step in plan:
        c, action = step["column"], step["action"]
        if c not in columns:
            continue
        values = sorted(r[c] for r in rows if r[c] is not None)
        if action == "drop":
            rows = [r for r in rows if r[c] is not None]
            continue
        if action == "drop_column":
            columns.remove(c)
            continue
        fill = None
        if action == "impute_mode":
            fill = min(set(values), key=lambda v: (-values.count(v), v)) if values else None
        elif types[c] == "text":
            continue
        elif values:
            fill = statistics.mean(values) if action == "impute_mean" else statistics.median(values)
        for r in rows:
            r[c] = fill if r[c] is None else r[c]
    return columns, sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_random_plans_equal_step_by_step(spark):
    rng = random.Random(3)
    columns, types = ["id", "a", "b", "c", "s", "t"], ["num", "num", "num", "num", "text", "text"]
    rows = [(float(i), *(rng.choice([None, *map(float, range(5))]) for _ in range(3)),
             *(rng.choice([None, "x", "y", "z"]) for _ in range(2))) for i in range(60)]
    empty = [(r[0], None, r[2], r[3], r[4], None) for r in rows]  # nothing to fill a and t with
    for trial in range(8):
        own = rows if trial % 2 else empty
        df = spark.createDataFrame(own, "id double, a double, b double, c double, s string, t string")
        plan = [{"column": rng.choice(columns[1:]), "action": rng.choice(C.ACTIONS if n % 4 == 3 else (
            "drop", "impute_mean", "impute_median", "impute_mode"))} for n in range(rng.randint(3, 10))]
        want_columns, want = stepwise(own, columns, types, plan)
        got = C.apply_cleaning_plan(df, plan)
        assert got.columns == want_columns, plan
        made = sorted((tuple(r) for r in got.collect()), key=repr)
        assert len(made) == len(want), plan
        for x, y in zip(made, want):
            assert all(p == q or math.isclose(p, q) for p, q in zip(x, y)), plan


def test_modes_of_all_types(spark):
    df = spark.sql("""
        SELECT * FROM VALUES
          (1, 10, 1.5D, float(0.1), 1.25BD, timestamp_ntz'2024-01-01 00:00:00.000001', timestamp'2024-11-03 06:30:00', date'2024-02-29', true, array(1, 2), X'FF00'),
          (2, 9, -2D, float(0.3), 1.5BD, timestamp_ntz'2023-01-01 00:00:00', timestamp'2024-11-03 05:30:00', date'2024-03-01', false, array(1), X'00'),
          (3, 10, -2D, float(0.3), 1.5BD, timestamp_ntz'2023-01-01 00:00:00', timestamp'2024-11-03 05:30:00', date'2024-03-01', false, array(1), X'00'),
          (4, 9, 1.5D, float(0.1), 1.25BD, null, null, null, null, null, null),
          (5, null, null, null, null, null, null, null, null, null, null)
        AS t(id, i, d, f, n, ntz, ts, dt, b, arr, bin)""")
    got = C.apply_cleaning_plan(df, [{"column": c, "action": "impute_mode"} for c in df.columns])
    assert got.dtypes == df.dtypes
    rows = {r.id: r for r in got.collect()}
    # ties by value, not by text: 9 before 10, -2 before 1.5
    assert rows[5][1:] == (9, -2.0, rows[4].f, rows[4].n, *rows[2][5:])


def scans(df):
    """Scans of the final plan, exchanges that are reused counted once."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


def test_scans_do_not_grow_with_the_steps(spark, tmp_path):
    df = spark.range(1000).select("id", *[F.when(F.col("id") % (i + 3) != 0, F.col("id") * i).alias(f"c{i}") for i in range(10)])
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    alternating = lambda n, fill: [{"column": f"c{i}", "action": (fill, "drop")[i % 2]} for i in range(n)]
    for fill, most in (("impute_mean", 2), ("impute_mode", 2), ("impute_median", 6)):
        few, many = (scans(C.apply_cleaning_plan(table, alternating(n, fill))) for n in (5, 10))
        assert many == few <= most, (fill, few, many)
