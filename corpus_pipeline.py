"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns the documents that go on; the last returns packed pieces.

In all stages null and empty texts are documents without words, repeated rows are rows of their own, an empty table gives an empty result, and
columns of any name pass through (the last stage returns its own columns). A null language or source is a value like others, a null id is kept as
it is; what each stage makes of them is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm.language_id import keep_known_languages
from tidegraph.llm.mixing import mixed_rows
from tidegraph.llm.near_dedup import keep_one_of_each
from tidegraph.llm.packing import pack
from tidegraph.llm.quality import keep_good
from tidegraph.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; an empty text has the score of the zero vector, copies have equal scores."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known for certain; those without a letter (null and empty texts too), or alike to several languages, go. Rows
    without a language aren't learned from, but judged like others."""
    return keep_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8. The smallest id stays; documents without words or id stay; of rows
    of one id the one whose text has the smallest hash stays."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source, the last. Documents without words are taken 0 times."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a text without tokens is a piece of its end alone. Equal pieces share out places in any order."""
    return pack(docs)


STAGES = [("quality_classifier", quality), ("language_id", language), ("minhash_near_dedup", near_dedup), ("mix_sources", mixing), ("best_fit_packing", packing)]

#: The classifier, the parser of languages and the tokenizer can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
