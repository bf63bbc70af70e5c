"""Training-corpus pipeline: five of the operators in a row over ``documents``.

1. ``language_id``: documents without words, or without a language that holds at least 0.4 of the
   posterior mass, go.
2. ``toxicity``: documents predicted toxic go.
3. ``near_duplicates``: of each component of near copies the smallest doc_id stays.
4. ``pii``: every span of personal data is replaced by its kind in brackets (and ``n_chars`` follows).
5. ``packing``: the texts are packed into sequences of 4096 tokens.

Each function takes (spark, docs, sf_dir) and works on all rows of ``docs``, with the models learned
from the documents it is given. Between the stages the documents are written as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, ngram_join, packing, pii, toxicity
from quarry.llm.common import store, tables

#: Held-out folds, learned models and connected components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.train(docs, tables(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    if "n_chars" not in masked.columns:
        return masked
    kind = dict(masked.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.char_length("text").cast(kind))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_duplicates", near_duplicates),
          ("pii", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
