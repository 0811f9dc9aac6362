"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

1. language: documents in no learnt language go.
2. lines: of matching lines all but the first go, and documents that lose all their words.
3. near_duplicates: one document of each group of near-duplicates stays.
4. decontamination: documents that hold a window of a benchmark item go.
5. packing: what is left is tokenised and packed; one row a piece.

Every stage but the last returns the columns that it was given. Stages that use Python bound the session's Arrow batches
by bytes (``bounded_batches``), so that a task's memory does not grow with the length of texts; ``run`` puts the bound back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import BATCHES, bounded_batches, table, written
from tallyspark.llm.decontamination import decontaminate
from tallyspark.llm.language_id import recognised
from tallyspark.llm.line_dedup import remove_lines
from tallyspark.llm.near_dup import deduplicate
from tallyspark.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return recognised(docs, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return remove_lines(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bounded_batches(spark)
    # Workers that serve other stages too remember fewer words.
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=200_000)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: Tokens, links and learnt n-grams can't be had in SQL; the tests look at each stage, and hold lines, near-duplicates and decontamination against SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the session's bound of Arrow batches is put back."""
    docs, bound = table(spark, sf_dir, "documents"), spark.conf.get(BATCHES)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    finally:
        spark.conf.set(BATCHES, bound)
    return docs
