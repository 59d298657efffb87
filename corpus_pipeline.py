"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bpe, decontaminate, exact_dedup, jaccard_join, language_id
from loomery.operators.row_keys import free_name, keyed
from loomery.operators.skew import join_ids
from loomery.shipping import shipped
from loomery.sources.staging import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, on however little evidence; null texts and texts without letters go.

    Each row is judged by its own text: null and repeated ids make no difference.
    """
    return language_id.recognised(docs, language_id.train(docs))


def drop_exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: that with the largest id (null is least; of ties, one)."""
    return exact_dedup.drop_repeats(docs)


def drop_near_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near copies: that with the least id (null is largest; of ties, one).

    Rows are linked one by one, also where they share an id or have none.
    """
    key = free_name(docs)
    rows = keyed(docs, "doc_id", key)
    found = jaccard_join.jaccard_components(rows, id_col=key)
    gone = staged(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)), "pipeline-near")
    return join_ids(rows, gone, key, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold an item of the benchmark; a clean row that shares its id with one stays."""
    key = free_name(docs)
    rows = keyed(docs, "doc_id", key)
    leaks = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    gone = staged(leaks.select(F.col("doc_id").alias(key)).distinct(), "pipeline-leaks")
    return join_ids(rows, gone, key, "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains, checked by decoding."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", shipped(identify_language)),
    ("exact dedup", shipped(drop_exact_repeats)),
    ("n-gram Jaccard join", shipped(drop_near_repeats)),
    ("benchmark decontamination", shipped(drop_contaminated)),
    ("byte-level BPE", shipped(tokenize)),
]

#: Language ID, near copies, fingerprints and merges have no SQL form; tests/llm hold brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
