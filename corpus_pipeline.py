"""A corpus pipeline: documents to token blocks, in five stages that each call one operator.

Every stage works on all that its predecessor kept, as Parquet that is read again. All stages take
whole texts of any length, keep columns that they don't know, and give an empty table for an empty
table. What they do with nulls, ties and repeated rows stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from simloom.llm._common import drop, scope, stored
from simloom.llm.decontaminate import remove_contaminated
from simloom.llm.jaccard_join import deduplicated
from simloom.llm.mixing import mixed
from simloom.llm.token_blocks import op1_token_blocks
from simloom.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from `labels`, fold 0 left out.

    A null text is empty, and scored as such; a null id is no label's. Repeated rows go or stay together.
    Without toxic labels all documents stay.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that similarities of 0.8 and more on five-word shingles connect.

    It is the one of the smallest id, null ids last; among rows of one id the one of the least hash of
    its text, then of its columns, so that one of repeated rows stays. Null texts and others without
    words all stay.
    """
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which benchmark windows make up a twentieth or more.

    Null texts, and null items of the benchmark, have no windows. Repeated rows go or stay together.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source, a null text has no words. Rows that differ in any column are rounded
    each by itself; equal ones are taken as often as all of them together.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token blocks, and from them doc_id, start, n_tokens and ids_crc32 of each document.

    A row for each row of the mix; null texts hold the end token alone, null ids come last, and rows of
    one id stand in the order of their texts' hashes.
    """
    return op1_token_blocks(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_blocks", tokens),
]

#: Learned weights, min-hash trees and random rounding have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again.

    What a stage has written besides its result goes when the next one starts, and its result when the
    next one's is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:
            found = keep(stored(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = found
    return STAGES[-1][1](spark, docs, sf_dir)
