"""From documents to training shards: quality rules, SimHash near-dedup, decontamination, mixing, token ids.

Each stage gets what the one before it kept, written as Parquet and read again.

Defined results of all stages: an empty table gives an empty table; columns beside the five of ``documents`` are dropped, whatever their names; texts
are read whole at any length; ids may be null or repeated, and rows are told apart by id and text, so no row goes for the sake of another one's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import decontaminate, mixing, quality, simhash, training_order
from headwater.llm.common import as_documents, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds. Null and empty texts have no words and fail; null languages
    and sources are groups of their own; repeated rows are judged alike and stay."""
    measured = materialise(quality.measure(as_documents(docs)), "pipeline-quality", "zstd")
    return as_documents(quality.judge(measured).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: one with an id before those without, then the least id, then the least hashes of the text. Rows
    without words are one group; of rows equal in id and text one stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; items without words are in no document; repeated rows stay or go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of a document that the mix takes, the last one cut to the source's exact budget. Documents without words are not
    taken; a null source is one source, the last; rows equal in id and text stand in for each other."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride records of token ids in training order. Null and empty texts have none; repeated rows have their records each."""
    return training_order.training_order(docs)


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("mixture", mixture), ("token_ids", token_ids),
]

#: SQL has no byte-pair encoder and no greedy tiling: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
