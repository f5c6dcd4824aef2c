"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.llm import decontaminate, ngram_join, packing, pii, quality
from vantarow.llm.common import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor the learned rules reject.

    Null and empty texts fail the base and go; a row without an id can't be named as rejected and stays. Without
    usable labels only the base rejects; repeated rows are judged alike; an empty table gives an empty result.
    """
    return quality.good_ones(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group linked by five-word shingles (Jaccard 0.8 or more).

    Texts without words link with nothing and stay, as do rows without an id; rows that repeat the document that
    stays, id included, stay too. An empty table gives an empty result.
    """
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item: none has half of an item's tokens in its tiles of five tokens or more.

    Null and empty texts leak nothing; null and empty items are in no document; of repeated rows all go or stay; rows
    without an id stay. Without documents or items nothing goes.
    """
    return decontaminate.clean_ones(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kinds; n_chars follows the new text.

    Null texts stay null (their n_chars too), empty ones empty; repeated rows are redacted alike; where spans overlap
    the one that starts first is named, of equal starts the kind that is listed first. An empty table stays empty.
    """
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens.

    Null and empty texts are one end token; repeated rows are packed each; an empty table gives an empty result.
    """
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: The last stage's tokenizer has no form in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
