"""A training-data pipeline over ``documents``: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgauge.llm import bpe, langid, mixing, near, suffix
from siltgauge.llm.common import durable
from siltgauge.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of letters in spans of the language that won; below it a text has none.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and mixtures in which no language holds half of the letters, go."""
    labelled = langid.label(docs.select(*COLUMNS), langid.fit(docs))
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return near.keep_one(docs.select(*COLUMNS))


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that start more than once go; every document stays with the rest."""
    cut = suffix.cut_repeats(docs, with_text=True, carry=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each copy taken, the last one of a source cut."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with their digests and those of the decoded text."""
    out = bpe.encode_frame(docs.select("doc_id", "source", "lang", "text"), tokenizer_path(), with_ids=True, keep_text=False)
    return out.select("doc_id", "source", "lang", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("long_repeats", long_repeats),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
