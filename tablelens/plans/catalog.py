"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads whole tables (or frames Spark derives from them) and runs
one library operator; ``ORACLE`` holds the equivalent SQL where one exists.
Doubles are rounded to a fixed number of places on both sides so that
summation order cannot change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analysis as A
from ..operators import charts as V
from ..operators import clean as C
from ..operators import text as X
from ..operators import privacy as M
from ..operators import profile as P
from ..operators import rate as R
from ..operators import retention as RT
from ..session import apply_defaults

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_defaults(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SIG_DIGITS = 10


def _sig(c):
    """``c`` rounded to SIG_DIGITS significant digits (same formula as
    :func:`_sig_sql`, so both engines round the same value the same way)."""
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))))
    keep = c.isNull() | (c == 0) | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(keep, c).otherwise(F.round(c / e, SIG_DIGITS - 1) * e)


def _sig_sql(c: str) -> str:
    e = f"power(10.0, floor(log10(abs({c}))))"
    return (f"CASE WHEN {c} IS NULL OR {c} = 0 OR isnan({c}) OR isinf({c}) THEN {c} "
            f"ELSE round({c} / {e}, {SIG_DIGITS - 1}) * {e} END")


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to SIG_DIGITS significant digits, so that
    summation order cannot change compared values (the oracle does the same)."""
    return df.select(*[_sig(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None, dbl: tuple[str, ...] | list[str] = ()):
    """Register a query; ``dbl`` names the double columns of the oracle SQL,
    which are rounded like :func:`rounded` does on the Spark side."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            q = sql.strip()
            if dbl:
                rep = ", ".join(f"{_sig_sql(c)} AS {c}" for c in dbl)
                q = f"SELECT * REPLACE ({rep}) FROM (\n{q}\n) AS oracle_q"
            ORACLE[name] = q
        return fn
    return deco


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --------------------------------------------------------------------------
# frames derived from the driver tables
# --------------------------------------------------------------------------

def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: natural NULLs in quality / toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS_LABELS_SQL = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                   "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
DOCS_LABELS_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


# --------------------------------------------------------------------------
# A1-A7
# --------------------------------------------------------------------------

@register("missing_values", _union([
    f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing "
    f"FROM {DOCS_LABELS_SQL}" for c in DOCS_LABELS_COLS]))
def q_missing_values(spark, sf_dir):
    return A.missing_values(docs_labels(spark, sf_dir))


def _describe_sql(tab: str, cols: list[str]) -> str:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [f"count({c})::DOUBLE n{i}", f"avg({c}) a{i}", f"stddev_samp({c}) s{i}",
                 f"min({c})::DOUBLE lo{i}", f"max({c})::DOUBLE hi{i}",
                 f"quantile_cont({c}, [0.25, 0.5, 0.75]) q{i}"]
    parts = []
    for i, c in enumerate(cols):
        for stat, e in zip(A.DESCRIBE_STATS, [f"n{i}", f"a{i}", f"s{i}", f"lo{i}", f"q{i}[1]",
                                              f"q{i}[2]", f"q{i}[3]", f"hi{i}"]):
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, "
                         f"{e}::DOUBLE AS value FROM a")
    return f"WITH a AS (SELECT {', '.join(aggs)} FROM {tab})\n" + _union(parts)


@register("describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC), ["value"])
def q_describe_numeric(spark, sf_dir):
    return rounded(A.describe_numeric(table(spark, sf_dir, "lineitem")))


def _describe_cat_sql(tab: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        t = (f"(SELECT sum(n) AS cnt, count(*) AS uniq, max(n) AS freq, "
             f"first(v ORDER BY n DESC, v ASC) AS top FROM (SELECT CAST({c} AS VARCHAR) AS v, "
             f"count(*) AS n FROM {tab} WHERE {c} IS NOT NULL GROUP BY 1))")
        for stat, e in (("count", "CAST(cnt AS VARCHAR)"), ("unique", "CAST(uniq AS VARCHAR)"),
                        ("top", "top"), ("freq", "CAST(freq AS VARCHAR)")):
            parts.append(f"SELECT '{c}' AS column_name, '{stat}' AS stat, {e} AS value FROM {t}")
    return _union(parts)


@register("describe_categorical", _describe_cat_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def q_describe_categorical(spark, sf_dir):
    return A.describe_numeric(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("value_counts", """
SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count FROM lineitem
WHERE l_partkey IS NOT NULL GROUP BY 1 ORDER BY count DESC, value ASC LIMIT 10""")
def q_value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@register("value_counts_text", """
SELECT text AS value, count(*) AS count FROM documents
WHERE text IS NOT NULL GROUP BY 1 ORDER BY count DESC, value ASC LIMIT 10""")
def q_value_counts_text(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "documents"), "text", 10)


def _corr_sql(tab: str, cols: list[str]) -> str:
    aggs = [f"stddev_samp({c}) d{i}" for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            aggs.append(f"CASE WHEN var_samp({a}) FILTER (WHERE {cols[j]} IS NOT NULL) > 0 AND "
                        f"var_samp({cols[j]}) FILTER (WHERE {a} IS NOT NULL) > 0 "
                        f"THEN corr({a}, {cols[j]}) END r{i}_{j}")
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            e = (f"CASE WHEN d{i} > 0 THEN 1.0 END" if i == j
                 else f"r{min(i, j)}_{max(i, j)}")
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, ({e})::DOUBLE AS r FROM a")
    return f"WITH a AS (SELECT {', '.join(aggs)} FROM {tab})\n" + _union(parts)


@register("correlation_matrix", _corr_sql("lineitem", LINEITEM_NUMERIC), ["r"])
def q_correlation_matrix(spark, sf_dir):
    return rounded(A.correlation_matrix(table(spark, sf_dir, "lineitem")))


def embedding_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 dimensions of ``embeddings`` as columns; one value in nine is missing."""
    gap = lambda i: F.col("vec_id") % 9 == i % 9
    return table(spark, sf_dir, "embeddings").select(*[
        F.when(~gap(i), F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(64)])


@register("correlation_wide", """
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings),
v AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM e WHERE vec_id % 9 <> i % 9),
p AS (SELECT a.i, b.i AS j, CASE WHEN var_samp(a.x) > 0 AND var_samp(b.x) > 0 THEN corr(a.x, b.x) END AS r
      FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY ALL)
SELECT 'd' || x.i AS x, 'd' || y.i AS y, CASE WHEN x.i = y.i AND p.r IS NOT NULL THEN 1.0 ELSE p.r END AS r
FROM (SELECT unnest(range(64)) AS i) x CROSS JOIN (SELECT unnest(range(64)) AS i) y
LEFT JOIN p ON p.i = x.i AND p.j = y.i""", ["r"])
def q_correlation_wide(spark, sf_dir):
    """Correlation of 64 columns with gaps, from co-moment blocks."""
    return rounded(A.correlation_matrix(embedding_columns(spark, sf_dir)))


_GROUP_SQL = {
    "mean": "avg(l_extendedprice)",
    "sum": "coalesce(sum(l_extendedprice), 0)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "median": "median(l_extendedprice)",
    "count": "count(l_extendedprice)",
}


def _make_group(agg: str):
    sql = (f"SELECT l_returnflag, {_GROUP_SQL[agg]} AS \"{agg}\" FROM lineitem "
           f"WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag")

    @register(f"groupby_{agg}", sql, [] if agg == "count" else [f'"{agg}"'])
    def q(spark, sf_dir):
        out = A.groupby_agg(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", agg)
        return rounded(out)
    return q


for _agg in A.GROUP_AGGS:
    _make_group(_agg)


ANOMALY_DBL = ["threshold", "percentage", "min_anomaly", "max_anomaly", "mean_anomaly",
               "std_anomaly"]


def _anomaly_sql(tab: str, col: str, thr: float) -> str:
    return f"""
WITH s AS (SELECT avg({col}) mu, stddev_samp({col}) sd, count(*) n_all FROM {tab}),
h AS (SELECT t.{col} AS x FROM {tab} t, s
      WHERE s.sd > 0 AND abs((t.{col} - s.mu) / s.sd) >= {thr})
SELECT '{col}' AS column_name, {thr}::DOUBLE AS threshold,
  CASE WHEN s.sd > 0 THEN (SELECT count(*) FROM h) END AS count,
  CASE WHEN s.sd > 0 THEN round_even((SELECT count(*) FROM h) * 100.0 / s.n_all, 2) END AS percentage,
  (SELECT min(x) FROM h) AS min_anomaly, (SELECT max(x) FROM h) AS max_anomaly,
  (SELECT avg(x) FROM h) AS mean_anomaly, (SELECT stddev_samp(x) FROM h) AS std_anomaly,
  CASE WHEN s.sd IS NULL OR s.sd = 0 THEN 'Insufficient variance for anomaly detection' END AS message
FROM s"""


@register("anomaly_detection", _anomaly_sql("lineitem", "l_extendedprice", 1.5), ANOMALY_DBL)
def q_anomaly_detection(spark, sf_dir):
    return rounded(A.anomaly_detection(table(spark, sf_dir, "lineitem"), "l_extendedprice", 1.5))


@register("anomaly_detection_events", _anomaly_sql("events", "value", 3.0), ANOMALY_DBL)
def q_anomaly_detection_events(spark, sf_dir):
    return rounded(A.anomaly_detection(table(spark, sf_dir, "events"), "value", 3.0))


_TREND_LABEL_SQL = {
    "D": "date_trunc('day', d)",
    "W": "CAST(date_trunc('week', d) + INTERVAL 6 DAY AS TIMESTAMP)",
    "M": "CAST(last_day(d) AS TIMESTAMP)",
    "Q": "CAST(last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH) AS TIMESTAMP)",
    "Y": "CAST(make_date(year(d), 12, 31) AS TIMESTAMP)",
}
_TREND_NAMES = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def _make_trend(freq: str):
    sql = (f"SELECT {_TREND_LABEL_SQL[freq]} AS period, avg(v) AS mean FROM "
           f"(SELECT l_shipdate AS d, l_extendedprice AS v FROM lineitem "
           f"WHERE l_shipdate IS NOT NULL AND l_extendedprice IS NOT NULL) GROUP BY 1")

    @register(f"trend_{_TREND_NAMES[freq]}", sql, ["mean"])
    def q(spark, sf_dir):
        return rounded(A.time_series_trend(table(spark, sf_dir, "lineitem"), "l_shipdate",
                                           "l_extendedprice", freq))
    return q


for _f in ("D", "W", "M", "Q", "Y"):
    _make_trend(_f)


@register("trend_text_dates", """
SELECT CAST(last_day(l_shipdate) AS TIMESTAMP) AS period, avg(l_quantity) AS mean FROM lineitem
WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1""", ["mean"])
def q_trend_text_dates(spark, sf_dir):
    """Dates as text, not ISO: the trend finds their format."""
    li = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "MM/dd/yyyy").alias("d"), "l_quantity")
    return rounded(A.time_series_trend(li, "d", "l_quantity", "M"))


# --------------------------------------------------------------------------
# P1-P9 profile
# --------------------------------------------------------------------------

LINEITEM_SCHEMA = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                   ("l_linenumber", "int"), ("l_quantity", "double"),
                   ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                   ("l_returnflag", "string"), ("l_linestatus", "string"),
                   ("l_shipdate", "timestamp_ntz")]
_NUMERIC_TYPES = {"bigint", "int", "double", "float", "smallint", "tinyint", "boolean"}
_ISO_OK = "CASE WHEN try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END"
PROFILE_DBL = ["mean", "median", "variance", "min", "max", "datetime_ratio"]


def _profile_row_sql(tab: str, pos: int, c: str, typ: str, ncols: int) -> str:
    null_d, null_t = "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"
    if typ in _NUMERIC_TYPES:
        klass = "'numeric'"
        num = (f"avg({c}), median({c})::DOUBLE, var_samp({c}), min({c})::DOUBLE, "
               f"max({c})::DOUBLE")
        dts = f"{null_t}, {null_t}, {null_d}, CAST(NULL AS VARCHAR)"
    elif typ.startswith("timestamp") or typ == "date":
        klass = "'datetime'"
        num = ", ".join([null_d] * 5)
        dts = f"min({c})::TIMESTAMP, max({c})::TIMESTAMP, {null_d}, CAST(NULL AS VARCHAR)"
    else:
        ratio = f"avg({_ISO_OK.format(c=c)})"
        is_dt = f"{ratio} >= 0.8"
        klass = f"CASE WHEN {is_dt} THEN 'datetime_like' ELSE 'categorical' END"
        num = ", ".join([null_d] * 5)
        dts = (f"CASE WHEN {is_dt} THEN min(try_cast({c} AS TIMESTAMP)) END, "
               f"CASE WHEN {is_dt} THEN max(try_cast({c} AS TIMESTAMP)) END, "
               f"coalesce({ratio}, 0.0)::DOUBLE, CASE WHEN {is_dt} THEN 'iso8601' END")
    return (f"SELECT '{c}' AS column_name, {pos} AS position, '{typ}' AS type, {klass} AS class, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS num_missing, "
            f"count(DISTINCT {c}) AS num_unique, {num}, {dts}, count(*) AS num_rows, "
            f"{ncols} AS num_cols FROM {tab}")


def _profile_sql(tab: str, schema: list[tuple[str, str]]) -> str:
    cols = ("column_name, position, type, class, num_missing, num_unique, mean, median, "
            "variance, min, max, datetime_min, datetime_max, datetime_ratio, datetime_format, "
            "num_rows, num_cols")
    rows = [_profile_row_sql(tab, i, c, t, len(schema)) for i, (c, t) in enumerate(schema)]
    return (f"SELECT * FROM (\n{_union(rows)}\n) AS p({cols})")


PROFILE_FLAT = ["column_name", "position", "type", "class", "num_missing", "num_unique", "mean",
                "median", "variance", "min", "max", "datetime_min", "datetime_max",
                "datetime_ratio", "datetime_format", "num_rows", "num_cols"]


@register("profile", _profile_sql("lineitem", LINEITEM_SCHEMA), PROFILE_DBL)
def q_profile(spark, sf_dir):
    return rounded(P.profile(table(spark, sf_dir, "lineitem")).select(*PROFILE_FLAT))


def _profile_part(name: str, cols: list[str], dbl: list[str], where: str = ""):
    sql = (f"SELECT {', '.join(cols)} FROM ({_profile_sql('lineitem', LINEITEM_SCHEMA)}) AS q"
           + (f" WHERE {where}" if where else ""))

    @register(name, sql, dbl)
    def q(spark, sf_dir):
        out = P.profile(table(spark, sf_dir, "lineitem"))
        if where:
            out = out.where(where)
        return rounded(out.select(*cols))
    return q


_profile_part("profile_classes", ["column_name", "position", "type", "class"], [])
_profile_part("profile_unique", ["column_name", "num_unique"], [])
_profile_part("profile_numeric", ["column_name", "mean", "median", "variance", "min", "max"],
              ["mean", "median", "variance", "min", "max"], "class = 'numeric'")
_profile_part("profile_datetime", ["column_name", "datetime_min", "datetime_max"], [],
              "class = 'datetime'")


@register("profile_unique_exact", _union([
    f"SELECT '{c}' AS column_name, count(DISTINCT {e}) AS num_unique FROM lineitem" for c, e in (
        ("far_key", "l_orderkey + 9007199254740992"), ("price", "l_extendedprice::DECIMAL(18,2)"),
        ("wide_price", "l_extendedprice::DECIMAL(30,2) + 1000000000000000000000"), ("l_shipdate", "l_shipdate"),
        ("l_returnflag", "l_returnflag"), ("l_tax", "l_tax"))]))
def q_profile_unique_exact(spark, sf_dir):
    """Distinct values that doubles can't tell apart: keys past 2^53, decimals, times."""
    return P.unique_counts(table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey + 9007199254740992 AS far_key", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
        "CAST(l_extendedprice AS DECIMAL(30,2)) + CAST('1000000000000000000000' AS DECIMAL(30,2)) AS wide_price",
        "l_shipdate", "l_returnflag", "l_tax"))


@register("profile_shape", "SELECT count(*) AS num_rows, CAST(11 AS BIGINT) AS num_cols FROM lineitem")
def q_profile_shape(spark, sf_dir):
    return P.profile_shape(table(spark, sf_dir, "lineitem"))


@register("profile_missing", _union([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS num_missing FROM {DOCS_LABELS_SQL}"
    for c in DOCS_LABELS_COLS]))
def q_profile_missing(spark, sf_dir):
    return P.column_stats(docs_labels(spark, sf_dir)).select("column_name", "num_missing")


_EVENTS_TEXT = "(SELECT CAST(ts AS VARCHAR) AS ts_text, event_type FROM events)"


@register("profile_datetime_text", _union([
    f"""SELECT '{c}' AS column_name,
      CASE WHEN avg({_ISO_OK.format(c=c)}) >= 0.8 THEN 'datetime_like' ELSE 'categorical' END AS class,
      avg({_ISO_OK.format(c=c)})::DOUBLE AS datetime_ratio,
      CASE WHEN avg({_ISO_OK.format(c=c)}) >= 0.8 THEN min(try_cast({c} AS TIMESTAMP)) END AS datetime_min,
      CASE WHEN avg({_ISO_OK.format(c=c)}) >= 0.8 THEN max(try_cast({c} AS TIMESTAMP)) END AS datetime_max
    FROM {_EVENTS_TEXT}""" for c in ("ts_text", "event_type")]), ["datetime_ratio"])
def q_profile_datetime_text(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("ts_text"),
                                                 "event_type")
    return rounded(P.profile(ev).select("column_name", "class", "datetime_ratio",
                                        "datetime_min", "datetime_max"))


@register("profile_top_values", _union([
    f"""SELECT '{c}' AS column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (
      SELECT v AS value, n AS count, row_number() OVER (ORDER BY n DESC, v ASC) AS rank
      FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1))
    WHERE rank <= 5""" for c in ("o_orderstatus", "o_orderpriority")]))
def q_profile_top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "orders"))


def spark_type_sql(col: str) -> str:
    """DuckDB type name -> Spark's simpleString, for metadata oracles."""
    return (f"CASE {col} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
            f"WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'float' "
            f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' "
            f"WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' "
            f"ELSE lower({col}) END")


# --------------------------------------------------------------------------
# C0-C6 cleaning (documents LEFT JOIN labels has natural NULLs)
# --------------------------------------------------------------------------

@register("missing_columns", f"""
WITH m AS ({_union([f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM {DOCS_LABELS_SQL}" for c in DOCS_LABELS_COLS])}),
t AS (SELECT column_name, {spark_type_sql('column_type')} AS type FROM (DESCRIBE SELECT * FROM {DOCS_LABELS_SQL}))
SELECT m.column_name, m.missing, t.type FROM m JOIN t ON m.column_name = t.column_name
WHERE m.missing > 0""")
def q_missing_columns(spark, sf_dir):
    return C.missing_columns(docs_labels(spark, sf_dir))


@register("clean_drop", f"SELECT * FROM {DOCS_LABELS_SQL} WHERE quality IS NOT NULL")
def q_clean_drop(spark, sf_dir):
    return C.drop_rows(docs_labels(spark, sf_dir), "quality")


@register("clean_drop_column", f"SELECT doc_id, lang, source, n_chars, quality FROM {DOCS_LABELS_SQL}")
def q_clean_drop_column(spark, sf_dir):
    return C.drop_column(docs_labels(spark, sf_dir), "toxic")


def _impute_sql(fill: str, cast: str = "::DOUBLE") -> str:
    return (f"SELECT doc_id, lang, source, n_chars, coalesce(quality{cast}, ({fill})) AS quality, "
            f"toxic FROM {DOCS_LABELS_SQL}")


@register("clean_impute_mean", _impute_sql(f"SELECT avg(quality) FROM {DOCS_LABELS_SQL}"), ["quality"])
def q_clean_impute_mean(spark, sf_dir):
    return rounded(C.impute_mean(docs_labels(spark, sf_dir), "quality"))


@register("clean_impute_median", _impute_sql(f"SELECT median(quality) FROM {DOCS_LABELS_SQL}"),
          ["quality"])
def q_clean_impute_median(spark, sf_dir):
    return rounded(C.impute_median(docs_labels(spark, sf_dir), "quality"))


@register("clean_impute_mode", _impute_sql(
    f"SELECT quality FROM {DOCS_LABELS_SQL} WHERE quality IS NOT NULL GROUP BY 1 "
    f"ORDER BY count(*) DESC, 1 LIMIT 1", ""))
def q_clean_impute_mode(spark, sf_dir):
    return C.impute_mode(docs_labels(spark, sf_dir), "quality")


CLEAN_PLAN = [
    {"column": "lang_n", "action": "drop"},
    {"column": "quality", "action": "impute_median"},
    {"column": "toxic", "action": "impute_mode"},
    {"column": "source", "action": "drop_column"},
    {"column": "no_such_column", "action": "impute_mean"},
    {"column": "n_chars", "action": "not_an_action"},
]


@register("clean_mean_then_mode", """
SELECT doc_id, coalesce(CASE WHEN source <> 'src3' THEN lang END, (
  SELECT lang FROM documents WHERE source <> 'src3' AND lang IS NOT NULL
  GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)) AS lang FROM documents""")
def q_clean_mean_then_mode(spark, sf_dir):
    """A mean of a text column does nothing; the mode after it fills the gaps."""
    base = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("source") != "src3", F.col("lang")).alias("lang"))
    return C.apply_cleaning_plan(base, [{"column": "lang", "action": "impute_mean"},
                                        {"column": "lang", "action": "impute_mode"}])


@register("clean_plan", f"""
WITH b AS (SELECT *, nullif(lang, 'en') AS lang_n FROM {DOCS_LABELS_SQL}),
d AS (SELECT * FROM b WHERE lang_n IS NOT NULL)
SELECT doc_id, lang, n_chars, coalesce(quality::DOUBLE, (SELECT median(quality) FROM d)) AS quality,
  coalesce(toxic, (SELECT toxic FROM d WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS toxic,
  lang_n
FROM d""", ["quality"])
def q_clean_plan(spark, sf_dir):
    base = docs_labels(spark, sf_dir).withColumn("lang_n", F.expr("nullif(lang, 'en')"))
    return rounded(C.apply_cleaning_plan(base, CLEAN_PLAN))


LONG_PLAN = [
    {"column": "nc", "action": "impute_median"},
    {"column": "src_n", "action": "drop"},
    {"column": "quality", "action": "impute_mean"},
    {"column": "quality", "action": "drop"},
    {"column": "lang_n", "action": "impute_mode"},
    {"column": "lang_n", "action": "drop"},
    {"column": "toxic", "action": "impute_mode"},
    {"column": "n_chars", "action": "drop_column"},
    {"column": "nc", "action": "impute_mean"},
    {"column": "nc", "action": "drop"},
]


@register("clean_plan_long", f"""
WITH b AS (SELECT *, nullif(lang, 'en') AS lang_n, nullif(source, 'src0') AS src_n,
             CASE WHEN n_chars % 7 <> 0 THEN n_chars END AS nc FROM {DOCS_LABELS_SQL}),
s1 AS (SELECT * REPLACE (coalesce(nc::DOUBLE, (SELECT median(nc) FROM b)) AS nc) FROM b),
s2 AS (SELECT * FROM s1 WHERE src_n IS NOT NULL),
s3 AS (SELECT * REPLACE (coalesce(quality::DOUBLE, (SELECT avg(quality) FROM s2)) AS quality) FROM s2),
s4 AS (SELECT * FROM s3 WHERE quality IS NOT NULL),
s5 AS (SELECT * REPLACE (coalesce(lang_n, (SELECT lang_n FROM s4 WHERE lang_n IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 1)) AS lang_n) FROM s4),
s6 AS (SELECT * FROM s5 WHERE lang_n IS NOT NULL),
s7 AS (SELECT * REPLACE (coalesce(toxic, (SELECT toxic FROM s6 WHERE toxic IS NOT NULL GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 1)) AS toxic) FROM s6)
SELECT * EXCLUDE (n_chars) FROM s7 WHERE nc IS NOT NULL""", ["quality", "nc"])
def q_clean_plan_long(spark, sf_dir):
    """Ten steps: fills that feed later drops, drops that later statistics follow."""
    base = docs_labels(spark, sf_dir).select(
        "*", F.expr("nullif(lang, 'en')").alias("lang_n"), F.expr("nullif(source, 'src0')").alias("src_n"),
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("nc"))
    return rounded(C.apply_cleaning_plan(base, LONG_PLAN))


# --------------------------------------------------------------------------
# M1-M7 privacy (customer with derived contact columns)
# --------------------------------------------------------------------------

def customer_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    email = F.lower(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@example.com")))
    return c.select(
        "c_custkey", "c_name", email.alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad(key, 7, "0")).alias("phone"),
        F.concat(F.lit("ID"), F.lpad(((F.col("c_custkey") * 7919) % 10000000).cast("string"), 9, "0"))
        .alias("national_id"),
        F.col("c_acctbal").alias("balance"), "c_mktsegment",
        F.when(F.col("c_custkey") % 5 != 0, email).alias("contact"))


PII_SQL = """(SELECT c_custkey, c_name,
  lower(replace(c_name, '#', '.') || '@example.com') AS email,
  '+1-555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
  'ID' || lpad(CAST((c_custkey * 7919) % 10000000 AS VARCHAR), 9, '0') AS national_id,
  c_acctbal AS balance, c_mktsegment,
  CASE WHEN c_custkey % 5 <> 0 THEN lower(replace(c_name, '#', '.') || '@example.com') END AS contact
FROM customer)"""


def _email_mask_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN instr({v}, '@') > 0 THEN "
            f"left(split_part({v}, '@', 1), 1) || '***@' || substr({v}, instr({v}, '@') + 1) "
            f"ELSE {v} END")


def _id_mask_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN length({v}) <= 4 THEN '****' ELSE "
            f"left({v}, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END")


def _fin_mask_sql(v: str) -> str:
    s = f"format('{{:,.0f}}', abs({v}))"
    return (f"CASE WHEN {v} IS NULL THEN NULL ELSE (CASE WHEN {v} < 0 THEN '-' ELSE '' END) || "
            f"'***' || CASE WHEN length({s}) > 3 THEN right({s}, 3) ELSE '' END END")


# written out here, not taken from the code under test: names as whole words, "_" being a letter
_NAME_WORDS = {
    "email": "email|e_mail|mail|e-mail",
    "id": "cnic|nic|national_id|ssn|passport|id_no|id_number|nid|tax_id",
    "financial": "salary|income|wage|payment|balance|account_no|credit|debit|bank_acc|revenue|earnings",
    "phone": "phone|mobile|cell|contact_no|tel|telephone",
}
_NAME_CASE = " ".join(f"WHEN regexp_matches(column_name, '(^|[^a-z0-9_])({words})($|[^a-z0-9_])', 'i') THEN '{kind}'"
                      for kind, words in _NAME_WORDS.items())


_PII_COLS = ["c_custkey", "c_name", "email", "phone", "national_id", "balance", "c_mktsegment",
             "contact"]


@register("detect_sensitive", f"""
WITH t AS (
  SELECT column_name, CASE {_NAME_CASE} END AS sensitive_type FROM (DESCRIBE SELECT * FROM {PII_SQL})),
n AS ({_union([f"SELECT '{c}' AS column_name, count({c}) AS values_to_mask FROM {PII_SQL}" for c in _PII_COLS])})
SELECT t.column_name, t.sensitive_type, n.values_to_mask
FROM t JOIN n ON t.column_name = n.column_name
WHERE t.sensitive_type IS NOT NULL""")
def q_detect_sensitive(spark, sf_dir):
    return M.detect_sensitive(customer_pii(spark, sf_dir))


_EMAIL_RE_SQL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.]+"


@register("detect_email_content", _union([
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_full_match({c}, '{_EMAIL_RE_SQL}') THEN 1.0 ELSE 0.0 END)::DOUBLE AS email_share, "
    f"coalesce(avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_full_match({c}, '{_EMAIL_RE_SQL}') THEN 1.0 ELSE 0.0 END) > 0.5, false) AS is_email FROM {PII_SQL}"
    for c in ("c_name", "email", "phone", "national_id", "c_mktsegment", "contact")]), ["email_share"])
def q_detect_email_content(spark, sf_dir):
    return rounded(M.detect_email_content(customer_pii(spark, sf_dir)))


@register("mask_email", f"SELECT c_custkey, {_email_mask_sql('email')} AS email FROM {PII_SQL}")
def q_mask_email(spark, sf_dir):
    from ..functions.masks import mask_email
    return customer_pii(spark, sf_dir).select("c_custkey", mask_email(F.col("email")).alias("email"))


@register("mask_id", f"SELECT c_custkey, {_id_mask_sql('c_name')} AS c_name FROM customer")
def q_mask_id(spark, sf_dir):
    from ..functions.masks import mask_id
    return table(spark, sf_dir, "customer").select("c_custkey", mask_id(F.col("c_name")).alias("c_name"))


@register("mask_phone", f"SELECT c_custkey, {_id_mask_sql('phone')} AS phone FROM {PII_SQL}")
def q_mask_phone(spark, sf_dir):
    from ..functions.masks import mask_id
    return customer_pii(spark, sf_dir).select("c_custkey", mask_id(F.col("phone")).alias("phone"))


@register("mask_financial", f"SELECT c_custkey, {_fin_mask_sql('c_acctbal')} AS c_acctbal FROM customer")
def q_mask_financial(spark, sf_dir):
    from ..functions.masks import mask_financial
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", mask_financial(F.col("c_acctbal"), T.DoubleType()).alias("c_acctbal"))


@register("mask_table", f"""
SELECT c_custkey, c_name, {_email_mask_sql('email')} AS email, {_id_mask_sql('phone')} AS phone,
  {_id_mask_sql('national_id')} AS national_id, {_fin_mask_sql('balance')} AS balance, c_mktsegment,
  CASE WHEN (SELECT avg(CASE WHEN contact IS NULL THEN NULL WHEN regexp_full_match(contact, '{_EMAIL_RE_SQL}') THEN 1.0 ELSE 0.0 END) FROM {PII_SQL}) > 0.5
       THEN {_email_mask_sql('contact')} ELSE contact END AS contact
FROM {PII_SQL}""")
def q_mask_table(spark, sf_dir):
    return M.mask_table(customer_pii(spark, sf_dir))




# --------------------------------------------------------------------------
# T1-T6 text columns
# --------------------------------------------------------------------------

def _redact_sql(col: str) -> str:
    """The three redactions in order, with their patterns written out for RE2."""
    e = f"regexp_replace({col}, '(api[_-]?key|x-api-key|authorization[:\\s]+bearer\\s+)[^\\s]+', '\\1[REDACTED]', 'gi')"
    e = f"regexp_replace({e}, '(postgres|mysql|sqlite|mongodb)://[^\\s]+', '[DATABASE_URL_REDACTED]', 'gi')"
    return f"regexp_replace({e}, '(token|secret|password)[:\\s]*[^\\s]{{8,}}', '\\1[REDACTED]', 'gi')"


@register("redact_secrets", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def q_redact_secrets(spark, sf_dir):
    return X.redact_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


_SCRIPT_SQL = "regexp_replace({c}, '(?is)<script[^>]*>.*?</script>', '', 'g')"


@register("sanitize_markdown", f"""
SELECT conv_id, turn, regexp_replace({_SCRIPT_SQL.format(c='text')}, 'on\\w+\\s*=', '', 'gi') AS text
FROM conversations""")
def q_sanitize_markdown(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.sanitize_markdown_column(t, "text")


@register("strip_scripts", f"SELECT page_id, {_SCRIPT_SQL.format(c='html')} AS html FROM pages")
def q_strip_scripts(spark, sf_dir):
    return X.strip_scripts_column(table(spark, sf_dir, "pages").select("page_id", "html"), "html")


def _esc_sql(x: str) -> str:
    """Escape brackets, and ``&`` where no complete reference begins."""
    refs = "'&amp;((#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)'"
    amp = f"regexp_replace(replace({x}, '&', '&amp;'), {refs}, '&\\1', 'g')"
    return f"replace(replace({amp}, '<', '&lt;'), '>', '&gt;')"


# written out here, not taken from the code under test
_HTML_TAGS = "'p','br','strong','em','u','h1','h2','h3','h4','h5','h6','ul','ol','li','blockquote','code','pre','table','tr','td','th','div','span'"
_ATTR_NAME = "lower(regexp_extract(a, '^[^\\s=]+', 0))"
_ATTR_VALUE = ("regexp_replace(regexp_replace(regexp_replace(a, '^[^\\s=]+\\s*=?\\s*', '', 's'), "
               "'^\"(.*)\"$', '\\1', 's'), '^''(.*)''$', '\\1', 's')")
_ENDS = "regexp_replace({}, '/([a-z0-9]+)', '</\\1>', 'g')"

HTML_SQL = f"""
WITH cut AS (
  SELECT page_id, list_transform(regexp_extract_all({_SCRIPT_SQL.format(c='html')},
    '<!--.*?-->|<[!?][^>]*>|</?[A-Za-z](?:[^<>"'']|"[^"]*"|''[^'']*'')*>|<|[^<]+', 0, 's'),
    lambda t: {{'token': t, 'name': lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))}}) AS parts
  FROM pages
), made AS (
  SELECT page_id, list_transform(parts, lambda p: {{
    'name': p.name,
    'kind': CASE WHEN p.name = '' THEN 'text' WHEN p.name NOT IN ({_HTML_TAGS}) THEN 'none'
                 WHEN starts_with(p.token, '</') THEN 'end'
                 WHEN p.name = 'br' OR ends_with(p.token, '/>') THEN 'text' ELSE 'start' END,
    'html': CASE WHEN p.name = '' AND regexp_matches(p.token, '^<[!?]') THEN ''
                 WHEN p.name = '' THEN {_esc_sql('p.token')}
                 ELSE '<' || p.name || list_aggregate(list_transform(
                   list_filter(regexp_extract_all(
                     regexp_replace(regexp_replace(p.token, '^</?[A-Za-z][A-Za-z0-9]*', ''), '/?>$', ''),
                     '[^\\s"''<>/=]+(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s"''=<>`]+))?', 0),
                     lambda a: {_ATTR_NAME} IN ('class', 'id')),
                   lambda a: ' ' || {_ATTR_NAME} || '="' || replace({_esc_sql(_ATTR_VALUE)}, '"', '&quot;') || '"')
                   || [''], 'string_agg', '')
                 || '>' || CASE WHEN ends_with(p.token, '/>') AND p.name <> 'br' THEN '</' || p.name || '>' ELSE '' END
            END,
    'out': '', 'stack': ''}}) AS parts
  FROM cut
), folded AS (
  SELECT page_id, list_reduce([{{'name': '', 'kind': '', 'html': '', 'out': '', 'stack': ''}}] || parts, lambda s, p: {{
    'name': '', 'kind': '', 'html': '',
    'out': CASE WHEN p.kind IN ('text', 'start') THEN s.out || p.html
                WHEN p.kind = 'end' AND p.name <> 'br' AND instr(s.stack || '/', '/' || p.name || '/') > 0
                THEN s.out || {_ENDS.format("substr(s.stack, 1, instr(s.stack || '/', '/' || p.name || '/') - 1)")}
                     || '</' || p.name || '>'
                ELSE s.out END,
    'stack': CASE WHEN p.kind = 'start' THEN '/' || p.name || s.stack
                  WHEN p.kind = 'end' AND p.name <> 'br' AND instr(s.stack || '/', '/' || p.name || '/') > 0
                  THEN substr(s.stack, instr(s.stack || '/', '/' || p.name || '/') + length(p.name) + 1)
                  ELSE s.stack END}}) AS f
  FROM made
)
SELECT page_id, f.out || {_ENDS.format('f.stack')} AS html FROM folded"""


@register("sanitize_html", HTML_SQL)
def q_sanitize_html(spark, sf_dir):
    return X.sanitize_html(table(spark, sf_dir, "pages").select("page_id", "html"), "html")


@register("token_estimate",
          "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def q_token_estimate(spark, sf_dir):
    return X.token_estimate_column(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   "text").select("doc_id", "tokens")


BUDGET_TOKENS = 256


@register("token_budget", f"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) // 4 <= {BUDGET_TOKENS} THEN text
  WHEN instr(t, chr(10)) > 0 AND length(t) - instr(reverse(t), chr(10)) > {int(4 * BUDGET_TOKENS * 0.8)}
  THEN substring(t, 1, length(t) - instr(reverse(t), chr(10)))
  ELSE t END AS text
FROM (SELECT doc_id, text, substring(text, 1, {4 * BUDGET_TOKENS}) AS t FROM documents)""")
def q_token_budget(spark, sf_dir):
    return X.token_budget_column(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 "text", BUDGET_TOKENS)


BULLET_HEADER = "(?i)the"
_LB_SQL = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


@register("section_bullets", f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '([.!?]) ', '\\1' || chr(10) || '* ', 'g') AS x FROM documents),
l AS (SELECT doc_id, unnest(string_split_regex(x, '{_LB_SQL}')) AS line,
             generate_subscripts(string_split_regex(x, '{_LB_SQL}'), 1) - 1 AS line_no FROM t),
s AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS sl FROM l),
h AS (SELECT doc_id, min(line_no) AS hdr FROM s WHERE regexp_matches(sl, '{BULLET_HEADER}') GROUP BY doc_id)
SELECT s.doc_id, CAST(s.line_no AS INTEGER) AS line_no,
       regexp_replace(sl, '^[ \\-*0-9.]+', '') AS bullet
FROM s JOIN h ON s.doc_id = h.doc_id
WHERE s.line_no > h.hdr AND sl <> '' AND NOT regexp_matches(sl, '{BULLET_HEADER}')
  AND regexp_matches(sl, '^([-*]|[0-9]+\\.)')""")
def q_section_bullets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.regexp_replace("text", r"([.!?]) ", "$1\n* ").alias("text"))
    return X.section_bullets(d, "text", ["doc_id"], BULLET_HEADER)


# --------------------------------------------------------------------------
# V1-V6 chart data
# --------------------------------------------------------------------------

_X_SQL = "(SELECT l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL)"


@register("chart_histogram", f"""
WITH r AS (SELECT min(x) AS lo, max(x) AS hi FROM {_X_SQL}),
c AS (SELECT CASE WHEN hi - lo = 0 THEN 1
                  ELSE least(CAST(floor((x - lo) / (hi - lo) * 10) AS BIGINT) + 1, 10) END AS bucket,
             count(*) AS cnt FROM {_X_SQL}, r GROUP BY 1)
SELECT CAST(g.bucket AS INTEGER) AS bucket, lo + (g.bucket - 1) * (hi - lo) / 10 AS lower,
       CASE WHEN g.bucket = 10 THEN hi ELSE lo + g.bucket * (hi - lo) / 10 END AS upper,
       coalesce(cnt, 0) AS count
FROM generate_series(1, 10) AS g(bucket) CROSS JOIN r LEFT JOIN c ON c.bucket = g.bucket
WHERE lo IS NOT NULL""", ["lower", "upper"])
def q_chart_histogram(spark, sf_dir):
    return rounded(V.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10))


@register("chart_box", f"""
WITH q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
                  quantile_cont(x, 0.75) AS q3 FROM {_X_SQL}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT 'l_extendedprice' AS column_name, count(*) AS count, min(x) AS min, max(f.q1) AS q1,
       max(f.median) AS median, max(f.q3) AS q3, max(x) AS max,
       min(x) FILTER (WHERE x >= lf AND x <= uf) AS whisker_low,
       max(x) FILTER (WHERE x >= lf AND x <= uf) AS whisker_high,
       count(*) FILTER (WHERE NOT (x >= lf AND x <= uf)) AS outliers
FROM {_X_SQL}, f""", ["min", "q1", "median", "q3", "max", "whisker_low", "whisker_high"])
def q_chart_box(spark, sf_dir):
    return rounded(V.box_plot(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@register("chart_bar", """
SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY count DESC, value ASC LIMIT 10""")
def q_chart_bar(spark, sf_dir):
    return V.bar_top(table(spark, sf_dir, "orders"), "o_orderpriority", 10)


@register("chart_heatmap", _corr_sql("lineitem", LINEITEM_NUMERIC[:10]), ["r"])
def q_chart_heatmap(spark, sf_dir):
    return rounded(V.heatmap(table(spark, sf_dir, "lineitem")))


@register("chart_anomaly", f"""
SELECT s.stat, s.value FROM ({_anomaly_sql("lineitem", "l_extendedprice", 1.5)}) a,
LATERAL (VALUES ('Min Anomaly', a.min_anomaly), ('Mean Anomaly', a.mean_anomaly),
                ('Max Anomaly', a.max_anomaly)) AS s(stat, value)
WHERE a.count > 0""", ["value"])
def q_chart_anomaly(spark, sf_dir):
    return rounded(V.anomaly_bar(table(spark, sf_dir, "lineitem"), "l_extendedprice", 1.5))


@register("chart_trend", """
SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS x, avg(o_totalprice) AS y FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1""", ["y"])
def q_chart_trend(spark, sf_dir):
    return rounded(V.trend_line(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "M"))




# --------------------------------------------------------------------------
# R1-R4 rate, retention, ranking
# --------------------------------------------------------------------------

RATE_LIMIT, RATE_WINDOW_S = 3, 86400


def _rate_fold_sql(limit: int, window_s: int) -> str:
    """R1 as a recursive fold per user (DuckDB): the list of admitted times
    inside the window is the state carried from one event to the next."""
    w = window_s * 1_000_000
    keep = f"list_filter(r.q, lambda x: x > e.t - {w})"
    return f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, ts, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn
  FROM events),
r(user_id, rn, event_id, ts, allowed, q) AS (
  SELECT user_id, rn, event_id, ts, {limit} > 0, CASE WHEN {limit} > 0 THEN [t] ELSE [] END
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.ts, len({keep}) < {limit},
         CASE WHEN len({keep}) < {limit} THEN list_append({keep}, e.t) ELSE {keep} END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, ts, allowed FROM r"""


@register("rate_admission", _rate_fold_sql(RATE_LIMIT, RATE_WINDOW_S))
def q_rate_admission(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return R.rate_admission(ev, "user_id", "ts", RATE_LIMIT, RATE_WINDOW_S, tiebreak="event_id")


@register("rate_window_count", f"""
SELECT event_id, user_id, ts, recent, recent < {RATE_LIMIT} AS allowed FROM (
  SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
    RANGE BETWEEN {RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND 1 PRECEDING) AS recent
  FROM events)""")
def q_rate_window_count(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return R.rate_window_count(ev, "user_id", "ts", RATE_LIMIT, RATE_WINDOW_S)


@register("rate_admission_stream", _rate_fold_sql(RATE_LIMIT, RATE_WINDOW_S))
def q_rate_admission_stream(spark, sf_dir):
    from ..session import shared_path
    from ..streaming.rate import rate_admission_stream, run_to_table
    events = table(spark, sf_dir, "events")
    path = shared_path(spark, "rate-stream")
    # twelve uneven stretches of time, written one after another; by hash one event in three
    # comes one stretch late. A micro-batch reads eight files, of whatever stretches.
    stretches, files = 12, 8
    lo, hi, rows = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    span = (hi - lo).total_seconds()
    share = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(lo).cast("timestamp"))) / F.lit(span * 1e6 + 1)
    stretch = F.floor(F.sqrt(share) * stretches) + (F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0).cast("int")
    for i in range(stretches + 1):
        events.where(F.coalesce(stretch, F.lit(0)) == i).repartition(files).write.parquet(f"{path}/source/{i}")
    late = span / 2  # the longest stretch is the last, 23/144 of the time
    # a last event of nobody, so much later that all others are due; it stays in the state itself
    end = hi + timedelta(seconds=2 * late + 2 * RATE_WINDOW_S)
    closing = events.limit(1).select(*[F.lit(end).cast(f.dataType).alias(f.name) if f.name == "ts"
                                       else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    closing.coalesce(1).write.parquet(f"{path}/source/{stretches + 1}")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
              .option("recursiveFileLookup", "true").parquet(f"{path}/source"))
    out = rate_admission_stream(stream, "user_id", "ts", "event_id", RATE_LIMIT, RATE_WINDOW_S,
                                watermark=f"{late} seconds", buckets=max(64, rows // 16_000))
    run_to_table(out, path + "/data", path + "/checkpoint")
    return spark.read.parquet(path + "/data").drop("late")


RETENTION_HOURS = 72


@register("retention_report", f"""
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT count(*) FILTER (WHERE ts < now - INTERVAL {RETENTION_HOURS} HOUR) AS expired_count,
       CAST(coalesce(sum(octet_length(encode(props))) FILTER (WHERE ts < now - INTERVAL {RETENTION_HOURS} HOUR), 0) AS BIGINT) AS expired_bytes,
       count(*) FILTER (WHERE NOT (ts < now - INTERVAL {RETENTION_HOURS} HOUR) OR ts IS NULL) AS kept_count
FROM events, m""")
def q_retention_report(spark, sf_dir):
    return RT.retention_report(table(spark, sf_dir, "events"), "ts", RETENTION_HOURS,
                               size_col="props")


@register("retention_apply", f"""
SELECT * FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL {RETENTION_HOURS} HOUR""")
def q_retention_apply(spark, sf_dir):
    return RT.apply_retention(table(spark, sf_dir, "events"), "ts", RETENTION_HOURS)


@register("retention_by_day", f"""
SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {RETENTION_HOURS} HOUR""", ["value"])
def q_retention_by_day(spark, sf_dir):
    """The events in a table by day, its last day written again; expired days are not read."""
    from ..session import shared_path
    events = table(spark, sf_dir, "events")
    path = shared_path(spark, "events-by-day")
    newest = events.agg(F.max("ts")).first()[0]
    RT.write_by_day(events, path, "ts")
    RT.write_by_day(events.where(F.to_date("ts") == F.lit(newest.date())), path, "ts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    return rounded(RT.retained_days(RT.read_by_day(spark, path, schema), "ts", RETENTION_HOURS, newest))


@register("rank_items", f"""
WITH i AS (
  SELECT d.doc_id, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS text,
         CASE WHEN l.quality IS NULL THEN 'n/a' ELSE CAST(l.quality * 100 AS VARCHAR) END AS r_raw,
         CAST(d.n_chars AS VARCHAR) AS s_raw
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT doc_id, text, r_raw, s_raw, try_cast(r_raw AS DOUBLE) AS r, try_cast(s_raw AS DOUBLE) AS s FROM i),
b AS (SELECT doc_id, text,
        CASE WHEN (r_raw IS NOT NULL AND r IS NULL) OR (s_raw IS NOT NULL AND s IS NULL) THEN 50.0 ELSE coalesce(r, 50.0) END AS relevance,
        CASE WHEN (r_raw IS NOT NULL AND r IS NULL) OR (s_raw IS NOT NULL AND s IS NULL) THEN 50.0 ELSE coalesce(s, 50.0) END AS significance
      FROM s WHERE text IS NOT NULL AND text <> '')
SELECT CAST(row_number() OVER (ORDER BY relevance DESC, significance DESC, doc_id ASC) AS INTEGER) AS rank,
       text, relevance::DOUBLE AS relevance, significance::DOUBLE AS significance, doc_id
FROM b ORDER BY relevance DESC, significance DESC, doc_id ASC LIMIT {RT.RANK_LIMIT}""",
          ["relevance", "significance"])
def q_rank_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "text",
        F.when(F.col("quality").isNull(), F.lit("n/a"))
        .otherwise((F.col("quality") * 100).cast("string")).alias("r_raw"),
        F.col("n_chars").cast("string").alias("s_raw"))
    return rounded(RT.rank_items(items, "text", "r_raw", "s_raw", "doc_id"))




# --------------------------------------------------------------------------
# W1-W4 plans and the report
# --------------------------------------------------------------------------

_NUMBER_SQL = "('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT', 'HUGEINT')"


def _default_plan_sql(tab: str, texts: list[str]) -> str:
    """The proposed plan of a table that has dates, numbers and texts that aren't dates."""
    category = "CASE " + " ".join(f"WHEN (SELECT avg({_ISO_OK.format(c=c)}) FROM {tab}) < 0.8 THEN '{c}'" for c in texts) + " END"
    return f"""
WITH c AS (SELECT * FROM (DESCRIBE {tab})),
n AS (SELECT list(column_name) AS num FROM c WHERE column_type IN {_NUMBER_SQL}),
d AS (SELECT list(column_name) AS dates FROM c WHERE column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE'),
f AS (SELECT num, num[1] AS first, dates[1] AS date, {category} AS cat,
        '{{"columns": ["' || array_to_string(num, '", "') || '"]}}' AS columns FROM n, d)
SELECT unnest([1, 2, 3, 4, 5, 6])::INTEGER AS step,
  unnest(['missing_values', 'describe_numeric', 'anomaly_detection', 'value_counts', 'correlation_matrix',
          'time_series_trend']) AS operation,
  unnest(['Assess missing values', 'Summarize numeric distributions', 'Detect anomalies in key numeric features',
          'Category distribution for ' || cat, 'Compute correlations between numeric features',
          'Analyze time-series trend']) AS task,
  unnest(['{{}}', columns, '{{"column": "' || first || '", "z_threshold": 3.0}}', '{{"column": "' || cat || '", "top_n": 10}}',
          columns, '{{"date_column": "' || date || '", "freq": "M", "value_column": "' || first || '"}}']) AS params
FROM f"""


@register("default_plan", _default_plan_sql("lineitem", ["l_returnflag", "l_linestatus"]))
def q_default_plan(spark, sf_dir):
    import json
    from . import plan as W
    li = table(spark, sf_dir, "lineitem")
    steps = W.default_plan(W.column_classes(li))
    return spark.createDataFrame(
        [(i + 1, s["operation"], s["task"], json.dumps(s["params"], sort_keys=True))
         for i, s in enumerate(steps)], "step int, operation string, task string, params string")


def parsed_rows(rows: DataFrame) -> DataFrame:
    """Result rows as ``(result, label, field, number)``: one row per number in a result's row, labelled
    by the row's texts in the order of their names."""
    fields = F.map_entries(F.from_json("row_json", "map<string,string>"))
    is_number = lambda e: e["value"].rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$")
    texts = F.array_sort(F.filter(fields, lambda e: e["value"].isNotNull() & ~is_number(e)))
    label = F.array_join(F.transform(texts, lambda e: e["value"]), "|")
    numbers = F.filter(fields, is_number)
    return rows.select("result", label.alias("label"), F.explode(numbers).alias("e")).select(
        "result", "label", F.col("e.key").alias("field"), F.col("e.value").cast("double").alias("number"))


def _parsed_sql(result: str, sql: str, texts: list[str], numbers: list[str]) -> str:
    label = "concat_ws('|', " + ", ".join(texts) + ")" if texts else "''"
    return _union([f"SELECT '{result}' AS result, {label} AS label, '{f}' AS field, \"{f}\"::DOUBLE AS number "
                   f"FROM ({sql}) WHERE \"{f}\" IS NOT NULL" for f in numbers])


def _missing_sql(tab: str, cols: list[str]) -> str:
    return _union([f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM {tab}" for c in cols])


def _counts_sql(tab: str, col: str) -> str:
    return (f"SELECT {col} AS value, count(*) AS count FROM {tab} WHERE {col} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count DESC, value LIMIT 10")


def _month_sql(tab: str, date: str, value: str, names: tuple[str, str] = ("period", "mean")) -> str:
    return (f"SELECT strftime(last_day({date}), '%Y-%m-%dT00:00:00.000') AS {names[0]}, avg({value}) AS {names[1]} "
            f"FROM {tab} WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1")


_HITS = ["threshold", "count", "percentage", "min_anomaly", "max_anomaly", "mean_anomaly", "std_anomaly"]
_LINEITEM_COLS = [c for c, _ in LINEITEM_SCHEMA]


@register("run_plan", _union([
    _parsed_sql("step_1_missing_values", _missing_sql("lineitem", _LINEITEM_COLS), ["column_name"], ["missing"]),
    _parsed_sql("step_2_describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC), ["column_name", "stat"], ["value"]),
    _parsed_sql("step_3_anomaly_detection", _anomaly_sql("lineitem", "l_orderkey", 3.0), ["column_name"], _HITS),
    _parsed_sql("step_4_value_counts", _counts_sql("lineitem", "l_returnflag"), ["value"], ["count"]),
    _parsed_sql("step_5_correlation_matrix", _corr_sql("lineitem", LINEITEM_NUMERIC), ["x", "y"], ["r"]),
    _parsed_sql("step_6_time_series_trend", _month_sql("lineitem", "l_shipdate", "l_orderkey"), ["period"], ["mean"]),
    _parsed_sql("step_7_groupby_agg", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem "
                "WHERE l_returnflag IS NOT NULL GROUP BY 1", ["l_returnflag"], ["median"])]), ["number"])
def q_run_plan(spark, sf_dir):
    from . import plan as W
    li = table(spark, sf_dir, "lineitem")
    steps = W.default_plan(W.column_classes(li))
    steps.append({"task": "Mean price by flag", "operation": "groupby_agg",
                  "params": {"by": "l_returnflag", "target": "l_extendedprice", "agg": "median"}})
    return rounded(parsed_rows(W.result_rows(W.run_plan(li, W.validate_plan(steps)))))


def report(spark, sf_dir) -> DataFrame:
    """Everything that ``analyze`` finds in ``lineitem`` as ``(result, row_json)``."""
    from . import plan as W
    return W.result_rows(W.analyze(table(spark, sf_dir, "lineitem")))


_HIST_SQL = """
SELECT b.bucket, lo + (b.bucket - 1) * (hi - lo) / 10 AS lower,
  CASE WHEN b.bucket = 10 THEN hi ELSE lo + b.bucket * (hi - lo) / 10 END AS upper,
  (SELECT count(*) FROM lineitem WHERE least(floor((l_orderkey - lo) / (hi - lo) * 10) + 1, 10) = b.bucket) AS count
FROM (SELECT unnest(range(1, 11)) AS bucket) b, (SELECT min(l_orderkey)::DOUBLE AS lo, max(l_orderkey)::DOUBLE AS hi FROM lineitem)"""
_BOX_SQL = """
WITH q AS (SELECT quantile_cont(l_orderkey, [0.25, 0.5, 0.75]) AS q FROM lineitem),
w AS (SELECT q[1] AS q1, q[2] AS median, q[3] AS q3, q[1] - 1.5 * (q[3] - q[1]) AS lf, q[3] + 1.5 * (q[3] - q[1]) AS uf FROM q)
SELECT 'l_orderkey' AS column_name, count(*) AS count, min(l_orderkey) AS min, max(q1) AS q1, max(median) AS median,
  max(q3) AS q3, max(l_orderkey) AS max, min(l_orderkey) FILTER (l_orderkey BETWEEN lf AND uf) AS whisker_low,
  max(l_orderkey) FILTER (l_orderkey BETWEEN lf AND uf) AS whisker_high,
  count(*) FILTER (NOT l_orderkey BETWEEN lf AND uf) AS outliers FROM lineitem, w"""
_REPORT_SQL = [
    _parsed_sql("step_1_missing_values", _missing_sql("lineitem", _LINEITEM_COLS), ["column_name"], ["missing"]),
    _parsed_sql("step_2_describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC), ["column_name", "stat"], ["value"]),
    _parsed_sql("step_3_anomaly_detection", _anomaly_sql("lineitem", "l_orderkey", 3.0), ["column_name"], _HITS),
    _parsed_sql("step_4_value_counts", _counts_sql("lineitem", "l_returnflag"), ["value"], ["count"]),
    _parsed_sql("step_5_correlation_matrix", _corr_sql("lineitem", LINEITEM_NUMERIC), ["x", "y"], ["r"]),
    _parsed_sql("step_6_time_series_trend", _month_sql("lineitem", "l_shipdate", "l_orderkey"), ["period"], ["mean"]),
    _parsed_sql("chart_histogram_numeric", _HIST_SQL, [], ["bucket", "lower", "upper", "count"]),
    _parsed_sql("chart_box_numeric", _BOX_SQL, ["column_name"],
                ["count", "min", "q1", "median", "q3", "max", "whisker_low", "whisker_high", "outliers"]),
    _parsed_sql("chart_bar_category", _counts_sql("lineitem", "l_returnflag"), ["value"], ["count"]),
    _parsed_sql("chart_correlation_heatmap", _corr_sql("lineitem", LINEITEM_NUMERIC), ["x", "y"], ["r"]),
    _parsed_sql("chart_anomaly_summary", _union([
        f"SELECT '{s} Anomaly' AS stat, {c}_anomaly AS value FROM ({_anomaly_sql('lineitem', 'l_orderkey', 3.0)}) WHERE count > 0"
        for s, c in (("Min", "min"), ("Mean", "mean"), ("Max", "max"))]), ["stat"], ["value"]),
    _parsed_sql("chart_line_timeseries", _month_sql("lineitem", "l_shipdate", "l_orderkey", ("x", "y")), ["x"], ["y"]),
]


@register("report_rows", _union(_REPORT_SQL), ["number"])
def q_report_rows(spark, sf_dir):
    """The whole report but its profile, which is a query of its own."""
    return rounded(parsed_rows(report(spark, sf_dir).where("result <> 'profile'")))


# --------------------------------------------------------------------------
# S1-S11 sources and sinks
# --------------------------------------------------------------------------

@register("read_csv", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer""", ["c_acctbal"])
def q_read_csv(spark, sf_dir):
    from ..session import shared_path
    from ..sources.csv import read_csv, write_table
    path = shared_path(spark, "customer-csv")
    write_table(table(spark, sf_dir, "customer"), path, "csv")
    return rounded(read_csv(spark, path))


@register("read_csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_read_csv_documents(spark, sf_dir):
    """Whole texts, with line breaks, quotes and blanks, through a CSV file and back."""
    from ..session import shared_path
    from ..sources.csv import read_csv, write_table
    path = shared_path(spark, "documents-csv")
    write_table(table(spark, sf_dir, "documents"), path, "csv")
    return read_csv(spark, path)


@register("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 2", ["c_acctbal"])
def q_preview(spark, sf_dir):
    from ..sources.tables import preview
    return rounded(preview(table(spark, sf_dir, "customer"), 2, ["c_custkey"]))


@register("schema_fingerprint", f"""
SELECT 'lineitem' AS table_name,
  sha256(string_agg(column_name || ':' || {spark_type_sql('column_type')}, '|' ORDER BY column_name))
  AS schema_fingerprint
FROM (DESCRIBE lineitem)""")
def q_schema_fingerprint(spark, sf_dir):
    from ..sources.tables import schema_fingerprint_frame
    return schema_fingerprint_frame(table(spark, sf_dir, "lineitem"), "lineitem")


@register("recent_topk", """
SELECT CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank,
       event_id, ts, user_id, event_type, value, props,
       'Historical Insight ' || CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS VARCHAR)
         || ': ' || props AS insight
FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 3""", ["value"])
def q_recent_topk(spark, sf_dir):
    from ..sources.memory import recent_memory
    ev = table(spark, sf_dir, "events")
    return rounded(recent_memory(ev, "purchase", 3, key="event_type", ts="ts", text="props",
                                 tiebreak="event_id"))


@register("memory_append", """
SELECT 'user' || user_id AS job_id, event_type AS schema_fingerprint, props AS insights_summary, min(ts) AS created_at
FROM events GROUP BY ALL""")
def q_memory_append(spark, sf_dir):
    """Every event's note appended to the memory, twice; each is stored once."""
    from ..session import shared_path
    from ..sources.memory import append_memories, read_memory
    notes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user"), F.col("user_id")).alias("job_id"), F.col("event_type").alias("schema_fingerprint"),
        F.col("props").alias("insights_summary"), F.col("ts").alias("created_at"))
    path = shared_path(spark, "memory")
    append_memories(notes, path)
    append_memories(notes, path)
    return read_memory(spark, path).drop("entry_key")


@register("history_topk", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", ["value"])
def q_history_topk(spark, sf_dir):
    from ..sources.memory import history
    return rounded(history(table(spark, sf_dir, "events"), 20, ts="ts", tiebreak="event_id"))

