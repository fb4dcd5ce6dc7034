"""Cleaning a corpus in stages, each an operator of ``mapweave.llm``, down to piece ids.

Every stage reads all that its predecessor kept. Stages on rows need no shuffle of texts; where
documents are dropped by id, the ids are joined, never collected. In every stage columns of any other names pass
through unchanged, very long texts are read whole, and an empty table gives an empty result; what
each does with null, empty and repeated texts and with ties is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontaminate, jaccard, lattice, quality, secrets
from mapweave.llm.session import checkpointed


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, fixed or adapted to their language and source, go.

    Null, empty and blank texts have too few words and go. Null languages and sources are groups of their own; repeated
    rows are judged each, and count each; a share equal to its threshold stays.
    """
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Rows with that id, repeated or not, are one document, of which one row stays; rows with a null id stay. Null, empty and
    blank texts are in no class and stay. A similarity of just 0.8 joins.
    """
    return jaccard.distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, at a share of just 0.8 of its shingles too.

    They go by id: all rows of an id that matches, and rows with a null id if one of them matches. Null, empty and blank
    texts and items match nothing; an item under five words counts as one shingle.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked and ``n_chars`` counted anew.

    Null, empty and blank texts stay as they are; repeated rows and null ids are masked each; of spans that begin together
    the first rule's name stands for both.
    """
    return secrets.redacted(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as its pieces' ids: doc_id, n_pieces, ids.

    Null and empty texts have no pieces, blank ones those of their characters; repeated rows and null ids are encoded each;
    of equal merges the leftmost comes first. Other columns are dropped.
    """
    return lattice.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("sentencepiece", sentencepiece),
]
#: SQL can express neither automata nor byte-pair merging; ``tests/llm/test_pipeline.py`` holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
