"""A corpus pipeline of four training-data operators over the documents of a directory.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; its result is written as
Parquet in the shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import jaccard, nbsvm, packing, risk_rules
from barloom.llm.common import table, written

#: Whole texts that a Python worker gets at a time while they are packed.
BATCH = 512


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the naive Bayes support vectors predict to be good."""
    return nbsvm.keep(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs."""
    return risk_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of the n-gram Jaccard join."""
    return jaccard.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two tokens, none across documents: one row per piece, with its ids.

    Written here, as executors still hold what the join needed: whole texts and ids go to and from Python in small batches.
    """
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return written(pieces, "packed", batch=BATCH, codec="zstd")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packed),
]

#: No SQL for a trained classifier and a byte-pair encoder; tests hold each stage and the whole against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)  # writes its rows itself
