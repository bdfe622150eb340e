"""From raw documents to packed sequences, in five stages; part of the corpus subpackage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; run() writes what it returns to the
shared folder and reads it back as the next one's docs. All but the last return the columns of
documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightwell.llm import exact_dedup, quality_rules, residual_packing, secret_index, simhash_ball
from brightwell.llm.common import scratch
from brightwell.llm.queries import vocabulary
from brightwell.sources import read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the model is fitted on the labelled documents at hand. Empty texts are scored too; an empty table gives no rows."""
    return quality_rules.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null: empty), that of the largest id; a null id is below all others. An empty table gives no rows."""
    return exact_dedup.drop_exact_copies(docs, one_each=True)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are no near copy (five words, Jaccard 0.8 or more) of one with a smaller id that stays.

    Null, empty and blank texts are alike; of rows without an id one stays only where no id has a text alike; of equal texts one row
    stays. An empty table gives no rows."""
    return simhash_ball.drop_near_copies(docs, one_each=True)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; null and empty texts stay as they are, and an empty table gives no rows."""
    return secret_index.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return residual_packing.pack(docs, vocabulary())


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("secrets", hide_secrets), ("packing", pack)]

#: SQL can't express the classifier, fingerprints and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another; the tables that a stage makes on its way go when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
