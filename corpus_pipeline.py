"""Documents to training tokens: drop toxic texts and texts of no clear language, keep one of each group of near copies, drop
texts that hold benchmark passages, encode what is left.

Every stage reads the Parquet table that the stage before wrote. All stages but the last return rows of documents with all
their columns as they are: none edits a text. Which rows go:

* toxicity: score 0.5 or more. The model is trained on the stage's own labelled rows that are not held out.
* language: texts without a letter and texts that lie between two languages.
* near_duplicates: all but the first row of each component of texts whose sets of five-word shingles have a Jaccard
  similarity of 0.8 or more. Texts without words stay.
* decontamination: texts in which ten consecutive words of a benchmark item occur (or all words of a shorter item).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripweave.llm import bpe, decontam, jaccard, language, toxicity
from tripweave.session import write_through

ORACLE_SQL = None  # trained models and the tokenizer are not SQL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def keep_clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unclear(docs, language.train(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, similarity=(8, 10))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens and the checksums of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_clear_language),
    ("near_duplicates", keep_one_copy),
    ("decontamination", decontaminate),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir))
    return docs
