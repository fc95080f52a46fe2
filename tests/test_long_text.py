"""Long texts are counted and ordered like short ones."""

from tablelens.operators import analysis as A
from tablelens.operators import profile as P


def test_long_text_counts_and_top_values(spark):
    a = "a" * 300
    b = "b" * 300
    mark = "\U0010FFFF" + "x"
    vals = [a, a, a, b, b, "short", "short", mark, None]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    top = [(r.value, r["count"]) for r in A.value_counts(df, "t", 10).collect()]
    assert top == [(a, 3), (b, 2), ("short", 2), (mark, 1)]  # ties by value, whatever the length
    prof = {r.column_name: r for r in P.profile(df).collect()}["t"]
    assert prof["num_unique"] == 4
    assert [(t.value, t["count"]) for t in prof["top_values"]][:3] == [(a, 3), (b, 2), ("short", 2)]
    desc = {r.stat: r.value for r in A.describe_categorical(df, ["t"]).collect()}
    assert desc == {"count": "8", "unique": "4", "top": a, "freq": "3"}


def test_documents_profile_top_values_are_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tv = P.top_values(docs, 3).collect()
    texts = {r.value for r in tv}
    src = {r.text for r in docs.collect()}
    assert texts and texts <= src
