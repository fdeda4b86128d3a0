"""A corpus pipeline: language ID, line dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents. Stages
keep clean documents: only texts without any letter, and all but one of each group of near copies, go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language_id, line_dedup, ngram_join, packing, pii
from spanloom.llm.common import materialize, read_table, ship
from spanloom.llm.queries import tokenizer_path


def with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` alone, n_chars being the text's length again."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null and empty texts and texts without letters."""
    ship(spark)
    model = language_id.fit(docs)
    return language_id.identify(docs, model).where("lang_pred != 'und'").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines found in ten documents or more."""
    ship(spark)
    return with_length(line_dedup.line_dedup(docs, min_docs=10), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that shingles of five words link at a similarity of 0.8 or more."""
    ship(spark)
    return ngram_join.drop_near_copies(docs, k=5, num=4, den=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return with_length(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, as pieces with their ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), capacity=1024)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies), ("pii", personal_data), ("packing", pack)]

#: The language filters and the tokenizer aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
