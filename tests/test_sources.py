import csv
import datetime as dt
import os
import random
import tempfile

import pytest

from tablelens.operators import retention as RT
from tablelens.sources import csv_records, jdbc, memory, tables
from tablelens.sources.csv import read_csv, write_table


def write(path, text, mode="w", encoding="utf-8"):
    with open(path, mode, encoding=encoding) as f:
        f.write(text)
    return path


def test_csv_types(spark):
    d = tempfile.mkdtemp()
    p = write(os.path.join(d, "a.csv"), "name,age,score,flag,when\nAlice,30,95,True,2024-01-01\n"
              "Bob,25,88.5,false,2024-02-01\nCharlie,NA,92,TRUE,\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "double",
                               "flag": "boolean", "when": "string"}
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[2] == ("Charlie", None, 92.0, True, None)


def test_csv_duplicate_headers_quotes_latin1(spark):
    d = tempfile.mkdtemp()
    p = write(os.path.join(d, "b.csv"), 'x,x,\n1,"a, ""q""",3\n')
    df = read_csv(spark, p)
    assert df.columns == ["x", "x.1", "Unnamed: 2"]
    assert df.collect()[0][1] == 'a, "q"'
    p2 = os.path.join(d, "c.csv")
    with open(p2, "wb") as f:
        f.write("city\nZürich\n".encode("latin-1"))
    assert read_csv(spark, p2).collect()[0][0] == "Zürich"


def test_csv_empty_file_errors(spark):
    d = tempfile.mkdtemp()
    p = write(os.path.join(d, "e.csv"), "")
    with pytest.raises(ValueError):
        read_csv(spark, p)


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([(1, 2.5, "a"), (3, 4.0, "b")], "x bigint, y double, z string")
    write_table(df, os.path.join(d, "out"))
    back = read_csv(spark, os.path.join(d, "out"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2.5, "a"), (3, 4.0, "b")]


@pytest.mark.parametrize("name,ok", [
    ("users", True), ("user_profiles", True), ("_temp_table", True), ("a" * 63, True),
    ("123table", False), ("user-table", False), ("user table", False), ("", False),
    ("a" * 64, False), ("users; DROP TABLE users;--", False), (None, False)])
def test_table_names(name, ok):
    assert jdbc.validate_table_name(name) is ok


def test_jdbc_options_and_limit():
    o = jdbc.jdbc_options("jdbc:postgresql://h/db", "users", 100)
    assert o["query"] == "SELECT * FROM users LIMIT 100"
    assert "FETCH FIRST 5 ROWS ONLY" in jdbc.jdbc_options("jdbc:derby:memory:x", "t", 5)["query"]
    assert jdbc.jdbc_options("jdbc:postgresql://h/db", "users", 50000)["query"].endswith("LIMIT 50000")
    assert jdbc.jdbc_options("jdbc:postgresql://h/db", "users")["dbtable"] == "users"  # the whole table
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:postgresql://h/db", "users", 0)
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:postgresql://h/db", "users; drop", 10)


def test_require_rows(spark):
    with pytest.raises(ValueError):
        tables.require_rows(spark.createDataFrame([], "a double"))
    assert tables.require_rows(spark.createDataFrame([(1.0,)], "a double")).count() == 1


def test_named_tables(spark):
    df = spark.createDataFrame([(1,)], "a int")
    tables.put_table(df, "tl_named", persist=True)
    assert tables.get_table(spark, "tl_named").count() == 1
    assert tables.drop_table(spark, "tl_named") is True
    assert tables.get_table(spark, "tl_named") is None


def test_fingerprint_and_preview(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 1)], "b string, a int")
    assert tables.schema_fingerprint(a) == tables.schema_fingerprint(b)
    c = spark.createDataFrame([(1, "x")], "a bigint, b string")
    assert tables.schema_fingerprint(a) != tables.schema_fingerprint(c)
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert [r.k for r in tables.preview(df, 2, ["k"]).collect()] == [1, 2]


def test_memory_and_history(spark):
    path = os.path.join(tempfile.mkdtemp(), "mem")
    for i in range(5):
        memory.append_memory(spark, path, f"job{i}", "fp1" if i != 2 else "fp2",
                             "  insight %d  " % i + "x" * 2000, dt.datetime(2024, 1, 1 + i))
    mem = spark.read.parquet(path)
    rec = memory.recent_memory(mem, "fp1", 3).collect()
    assert [r.job_id for r in rec] == ["job4", "job3", "job1"]
    assert rec[0].insight.startswith("Historical Insight 1: insight 4")
    assert len(rec[0].insights_summary) == 1500
    assert [r.job_id for r in memory.history(mem, 2).collect()] == ["job4", "job3"]
    with pytest.raises(ValueError):
        memory.history(mem, 201)


def test_csv_texts_come_back_whole(spark, tmp_path):
    rows = [(1, "a\nb"), (2, "  lead and trail "), (3, 'quote " and, comma'), (4, "12D"), (5, "\tx\n\ny")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    path = str(tmp_path / "csv")
    write_table(df, path)
    got = read_csv(spark, path)
    assert sorted(map(tuple, got.collect())) == rows and got.dtypes == [("id", "bigint"), ("t", "string")]


def test_csv_codes_stay_text(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("code,x,y\n12D,1e3,+7\n3F,.5,8\n7D,2.,-9\n")
    got = read_csv(spark, str(path))
    assert got.dtypes == [("code", "string"), ("x", "double"), ("y", "bigint")]
    assert [r.code for r in got.collect()] == ["12D", "3F", "7D"]


def test_csv_row_with_more_fields_is_an_error(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, str(path)).collect()
    path = tmp_path / "short.csv"
    path.write_text("a,b\n1,2\n6\n")
    assert sorted((r.a, r.b) for r in read_csv(spark, str(path)).collect()) == [(1, 2), (6, None)]


def test_memory_strips_lines_too(spark, tmp_path):
    memory.append_memory(spark, str(tmp_path / "m"), "j", "f", "\n\t some insight \n")
    assert spark.read.parquet(str(tmp_path / "m")).first().insights_summary == "some insight"


def csv_file(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\r\n" if path.endswith("r.csv") else "\n").writerows(rows)


@pytest.mark.parametrize("name", ["n.csv", "r.csv"])
def test_csv_with_line_breaks_in_many_splits(spark, tmp_path, name):
    """Records, and fields longer than several splits, across split ends; one file, many tasks."""
    rng = random.Random(9)
    texts = ["plain", "two\nlines", 'say "yes",\n"no"', "\n\n", "a" * 300 + "\n" + "b" * 900, 'q"', '"', ",", "x\r\ny", " "]
    rows = [(str(i), rng.choice(texts) + f" {i}", "end") for i in range(400)]
    p = str(tmp_path / name)
    csv_file(p, [("id", "the\ntext", "last"), *rows])
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = read_csv(spark, p)
        assert got.columns == ["id", "the\ntext", "last"]
        assert sorted(map(tuple, got.collect())) == sorted((int(i), t, e) for i, t, e in rows)
        assert csv_records._lines(spark, p, "UTF-8").rdd.getNumPartitions() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, read_csv(spark, p).collect())) == sorted((int(i), t, e) for i, t, e in rows)


def test_csv_records_of_many_files_and_encodings(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(("\n\nk,v\n%d,\"é\n%d\"\n\n" % (i, i)).encode("latin-1"))
    got = read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(i, f"é\n{i}") for i in range(3)]
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "o.csv").write_text('k,v\n1,"never\nclosed\n')
    assert csv_records.records(spark, str(tmp_path / "open")).count() == 2


def test_repeated_appends_leave_one_entry(spark, tmp_path):
    path = str(tmp_path / "m")
    for n in range(3):
        memory.append_memory(spark, path, "job1", "fp1", " same insight ", dt.datetime(2024, 1, 1 + n))
    memory.append_memory(spark, path, "job1", "fp1", "other insight", dt.datetime(2024, 2, 1))
    memory.append_memory(spark, path, "job1", "fp2", "same insight", dt.datetime(2024, 2, 2))
    held = memory.read_memory(spark, path)
    assert sorted((r.schema_fingerprint, r.insights_summary, r.created_at.day) for r in held.collect()) == [
        ("fp1", "other insight", 1), ("fp1", "same insight", 1), ("fp2", "same insight", 2)]
    recent = memory.recent_memory(held, "fp1", 3)
    assert [r.insight for r in recent.collect()] == [
        "Historical Insight 1: other insight", "Historical Insight 2: same insight"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(schema_fingerprint" in plan


def test_table_by_day(spark, tmp_path):
    path, schema = str(tmp_path / "d"), "id int, ts timestamp_ntz"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    RT.write_by_day(spark.createDataFrame(rows, schema), path, "ts")
    RT.write_by_day(spark.createDataFrame(rows[8:16], schema), path, "ts")  # again: part of days 3 to 5
    days = {t.date() for _, t in rows[8:16]}
    want = [r for r in rows if r[1] is None or r[1].date() not in days] + rows[8:16]
    table = RT.read_by_day(spark, path, schema)
    assert sorted(r.id for r in table.collect()) == sorted(i for i, _ in want)
    now = t0 + dt.timedelta(hours=300)
    kept = RT.retained_days(table, "ts", 72, now)
    cut = now - dt.timedelta(hours=72)
    assert sorted(r.id for r in kept.collect()) == sorted(i for i, t in want if t is None or t >= cut)
    assert "PartitionFilters: [(isnull(_day" in kept._jdf.queryExecution().executedPlan().toString()
    gone = {r.day: r.rows for r in RT.expired_days(table, 72, now).collect()}
    assert gone == {d: sum(t is not None and t.date() == d for _, t in want) for d in {t.date() for _, t in want if t}
                    if d < cut.date()}
