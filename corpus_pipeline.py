"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again before the next one starts. All but the last keep the columns of ``documents``, extra ones too,
whatever their names.

Defined results of all stages: a null text counts as empty, and empty documents give empty results. Equal texts are
one document after the second stage; of rows that repeat an id, those that the stages judge by text are judged
row by row, and near copies by id. Rows whose id is null are kept unless their text is rejected or a copy. Texts go
up to Spark's 2 GB of a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, exact_dedup, mixing, near_copies, quality
from gridweave.llm.text import table
from gridweave.plans.staging import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from rows outside the held-out quarter."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, network)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id."""
    return exact_dedup.exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), that of the smallest doc_id."""
    return near_copies.drop_near_copies(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattened source shares: every document at least once, small sources up to four times."""
    return mixing.mixed(docs, mixing.Target(max_repetition=4.0))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every placed document, with the digests of ids and decoded text."""
    decoded = bpe.encode(docs, decoded=True)
    return decoded.select(F.col("id").alias("doc_id"), *bpe.digests(decoded), "ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode_tokens),
]

#: The classifier is learned and the mix is found by bisection; neither is a query that SQL can state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
