"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them to the table ``documents``; between
stages the documents are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import table, written
from tablelens.llm.line_dedup import dedup_lines
from tablelens.llm.mixing import mix
from tablelens.llm.packing import in_file_order, pack_documents
from tablelens.llm.quality import quality_rules
from tablelens.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents repeat; n_chars follows the text."""
    done = dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 4-word shingles, at most 4 differing bits."""
    return keep_one(docs, radius=4, shingle=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources keep their target weights."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of at most 4096 tokens.

    The sequences follow the order in which the mixing wrote the documents.
    """
    return pack_documents(in_file_order(docs, "_position"), size=4096, order_col="_position")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

# SQL can't express the hashes, the schedule and the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
