import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"

# names that operators use inside, as extra columns of the input
CLASHES = ["row", "_row", "key", "holder", "size", "fp", "word", "n", "a", "b", "pos", "task", "kept", "uni",
           "version", "range", "_id", "places", "position", "weights", "kept_text"]

LONG_LINE = "This line is certainly longer than forty characters in all"
ODD_ROWS = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, "one", "de", "s"),
    (5, "two words", None, "s"), (6, "same text here, quite short", "en", "s"), (7, "same text here, quite short", "en", "t"),
    (7, "same text here, quite short", "en", "t"), (8, LONG_LINE + "\nx", "en", "s"), (9, " " + LONG_LINE.upper() + "\r\ny", "en", "s"),
    (10, LONG_LINE, "en", "s"), (11, LONG_LINE + "\n" + LONG_LINE, "en", "s"), (12, LONG_LINE + "\n", "en", "t"),
    (None, "a row without an id", "en", "s"), (None, "another row without an id", None, None),
    (14, "Ünïcödé — ﬁne … 日本語 текст 𝔘𝔫𝔦", "de", "s"), (15, "word " * 9000, "en", "s"), (16, "x" * 30000, "en", "s"),
    (17, "12345 67890 !!! ***", "en", "s"), (18, "<|endoftext|> and <|ENDOFTEXT|> it's here", "en", "s"),
]


def odd_frame(spark, rows=ODD_ROWS):
    """The odd rows as a table of documents, with extra columns of clashing names."""
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(
        [(i, t, lang, s, None if t is None else len(t), *CLASHES) for i, t, lang, s in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def odd(spark):
    return odd_frame(spark)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small():
    """The documents of the smallest table, by id."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
