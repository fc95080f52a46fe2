"""What a report needs of a table, gathered once: three scans, then only their small results.

One aggregation holds the statistics of all columns and the correlations of a few numeric ones; the typed
frequency table of numbers and times and that of texts (see :mod:`profile`) hold every column's
distribution. They are written to the shared folder, and the profile, descriptions, quantiles, anomalies,
value counts, histograms and box plots of a report follow from them, with the rows that the
operators would give over the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric
from ..session import shared_path
from . import analysis as A
from . import profile as P
from .common import long_rows, message_frame, require_columns
from .quantiles import exact_quantiles


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"facts-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Facts:
    """The gathered facts of ``df``. Methods give an operator's result, or None where they can't tell it."""

    def __init__(self, df: DataFrame):
        self.df, self.fields = df, df.schema.fields
        self.place = {f.name: i for i, f in enumerate(self.fields)}
        if len(self.place) < len(self.fields):
            raise ValueError("columns need different names")
        self.numeric = [f.name for f in self.fields if is_numeric(f.dataType)]
        self.texts = [f.name for f in self.fields if isinstance(f.dataType, T.StringType)]
        self.pairs, self.r, self.one = [], [], None
        if len(self.fields) > A.WIDE:
            self.stats = _kept(P._stats_frame(df), "statistics")
        else:
            exprs, rows = P.stats_parts(df)
            if 2 <= len(self.numeric) <= A.FEW_COLUMNS:
                # named dI and rI_J; the statistics have names of other kinds
                more, self.pairs, self.r = A.correlation_parts(df, self.numeric)
                exprs = exprs + more
            self.one = _kept(df.agg(*exprs), "statistics")
            self.stats = P.stats_rows(self.one, rows)
        counted = any(P.schema_class(f.dataType) in (P.NUMERIC_CLASS, P.DATETIME_CLASS) for f in self.fields)
        self.number_counts = _kept(P.number_frequency(df), "numbers") if counted else None
        self.text_counts = _kept(A.frequency_table(df, self.texts), "texts") if self.texts else None

    def profile(self) -> DataFrame:
        return P.profile(self.df, stats=self.stats, numbers=self.number_counts, texts=self.text_counts)

    def missing_values(self) -> DataFrame:
        return self.stats.select("column_name", F.col("num_missing").alias("missing"))

    def _is_number(self, column) -> bool:
        return isinstance(column, str) and column in self.place and is_numeric(
            self.fields[self.place[column]].dataType, include_bool=True)

    def _values(self, columns: list[str]) -> DataFrame:
        """(position, x, n): the values of numeric columns and how often each stands."""
        return self.number_counts.where(F.col("position").isin([self.place[c] for c in columns])).select(
            "position", "x", "n")

    def _quartiles(self, columns: list[str]) -> DataFrame:
        return exact_quantiles(self._values(columns), ["position"], "x", [0.25, 0.5, 0.75], small_keys=True, weight="n")

    def describe_numeric(self, columns=None) -> DataFrame | None:
        cols = require_columns(self.df, columns) if columns else self.numeric
        num = list(dict.fromkeys(c for c in cols if c in self.numeric))
        if not num or len(num) < len(cols):
            return None
        names = self.stats.where(F.col("column_name").isin(num)).join(
            F.broadcast(self._quartiles(num)), "position", "left")  # a row a column
        values = {"count": F.col("n_rows") - F.col("num_missing"), "mean": F.col("mean"), "std": F.sqrt("variance"),
                  "min": F.col("min"), "25%": F.col("q")[0], "50%": F.col("q")[1], "75%": F.col("q")[2], "max": F.col("max")}
        return names.select("column_name", F.inline(F.array(*[
            F.struct(F.lit(s).alias("stat"), v.cast("double").alias("value")) for s, v in values.items()])))

    def value_counts(self, column, top_n: int = 10) -> DataFrame | None:
        if column not in self.texts or not isinstance(top_n, int) or isinstance(top_n, bool) or top_n < 1:
            return None
        counts = self.text_counts.where(F.col("column_name") == column)
        return counts.orderBy(F.desc("n"), F.asc("value")).limit(top_n).select("value", F.col("n").alias("count"))

    def correlation_matrix(self, columns=None) -> DataFrame | None:
        if not self.pairs or columns and list(columns) != self.numeric:
            return None
        return long_rows(self.one, self.pairs, self.r, ["x", "y"], "r")

    def anomaly_detection(self, column, z_threshold: float = 3.0) -> DataFrame | None:
        if not self._is_number(column):
            return None
        thr = float(z_threshold)
        stats = self.stats.where(F.col("column_name") == column).select(
            "n_rows", F.col("mean").alias("mu"), F.sqrt("variance").alias("sd"))
        z = F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))
        hits = self._values([column]).crossJoin(F.broadcast(stats)).where(~F.isnan(z) & (F.abs(z) >= thr))
        # sums about the column's mean, so that a large offset costs no digits
        d = F.col("x") - F.col("mu")
        total = hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cnt"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                         F.try_divide(F.sum(F.col("n") * d), F.sum("n")).alias("off"))
        spread = hits.crossJoin(F.broadcast(total.select("off"))).agg(
            F.sum(F.col("n") * (d - F.col("off")) ** 2).alias("ss"))
        one = stats.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(spread))  # one row each
        ok = F.col("sd").isNotNull() & ~F.isnan("sd") & (F.col("sd") != 0)
        return one.select(
            F.lit(column).alias("column_name"), F.lit(thr).alias("threshold"),
            F.when(ok, F.col("cnt")).cast("bigint").alias("count"),
            F.when(ok, F.bround(F.col("cnt") * 100.0 / F.col("n_rows"), 2)).alias("percentage"),
            F.when(ok, F.col("lo")).alias("min_anomaly"), F.when(ok, F.col("hi")).alias("max_anomaly"),
            F.when(ok, F.col("mu") + F.col("off")).alias("mean_anomaly"),
            F.when(ok & (F.col("cnt") > 1), F.sqrt(F.col("ss") / F.greatest(F.col("cnt") - 1, F.lit(1)))).alias("std_anomaly"),
            F.when(~ok, F.lit("Insufficient variance for anomaly detection")).alias("message"))

    def histogram(self, column, bins: int = 10) -> DataFrame | None:
        if not self._is_number(column):
            return None
        x = self._values([column]).where(F.abs("x") < F.lit(float("inf")))
        rng = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        width = F.col("hi") - F.col("lo")
        b = F.when(width == 0, F.lit(1)).otherwise(
            F.least(F.floor((F.col("x") - F.col("lo")) / width * bins) + 1, F.lit(bins)))
        counts = x.crossJoin(F.broadcast(rng)).groupBy(b.cast("int").alias("bucket")).agg(F.sum("n").alias("count"))
        grid = self.df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bucket")).crossJoin(
            F.broadcast(rng)).where(F.col("lo").isNotNull())
        return grid.join(counts, "bucket", "left").select(
            "bucket", (F.col("lo") + (F.col("bucket") - 1) * width / bins).alias("lower"),
            F.when(F.col("bucket") == bins, F.col("hi")).otherwise(
                F.col("lo") + F.col("bucket") * width / bins).alias("upper"),
            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))

    def box_plot(self, column) -> DataFrame | None:
        if not self._is_number(column):
            return None
        x = self._values([column])
        q = self._quartiles([column]).select(*[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
        one = self.df.sparkSession.range(1).select(F.lit(1).alias("_one")).join(
            q.withColumn("_two", F.lit(1)), F.col("_one") == F.col("_two"), "left").drop("_one", "_two")
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
        weigh = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
        res = x.crossJoin(F.broadcast(one)).agg(
            weigh(F.lit(True)).alias("count"), F.min("x").alias("min"), F.max("q1").alias("q1"), F.max("median").alias("median"),
            F.max("q3").alias("q3"), F.max("x").alias("max"), F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"), weigh(~inside).alias("outliers"))
        return res.select(F.lit(column).alias("column_name"), *res.columns)

    def step(self, operation: str, params: dict) -> DataFrame | None:
        """A plan step's result, if the facts tell it."""
        if operation == "describe_numeric" and not self.numeric and not params.get("columns"):
            return message_frame(self.df.sparkSession, "No numeric columns available")
        wanted = {"missing_values": (), "describe_numeric": ("columns",), "value_counts": ("column", "top_n"),
                  "correlation_matrix": ("columns",), "anomaly_detection": ("column", "z_threshold")}
        if operation not in wanted:
            return None
        return getattr(self, operation)(**{k: params[k] for k in wanted[operation] if k in params})
