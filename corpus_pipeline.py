"""The corpus pipeline: quality filter, near-duplicate join, benchmark
decontamination, pseudonyms and packing, each over what the one before has kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, packing, parity_join, pii, quality_mil
from quarry.llm.scratch import written
from quarry.sources.tables import read_table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Documents handed to a Python worker at a time: with some KB each, a few MB on both sides
#: of the pipe, where the default of 10,000 rows holds over 30 MB several times over.
ROWS_A_BATCH = 1000


def in_small_batches(stage):
    """A stage whose jobs hand documents to Python in batches of ``ROWS_A_BATCH``."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)
        return stage(spark, docs, sf_dir)
    return run_stage


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_mil.accepted(docs, quality_mil.train(docs, read_table(spark, sf_dir, "labels")))


@in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return parity_join.keep_first(docs)


@in_small_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@in_small_batches
def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced in their format."""
    return pii.pseudonyms(docs, key=pii.TRIAL_KEY)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token streams, laid out in training windows."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID, with_ids=True)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", decontaminated),
          ("pseudonyms", pseudonymised), ("packing", packed)]

#: Training, Hamming windows and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
