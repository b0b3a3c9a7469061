"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.  Rows with nulls, empty texts and repeated rows are
handled as the operators' docstrings say; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchhouse.llm import curve_pack, jaccard_join, quality_fm, rule_cascade, suffix_dedup
from watchhouse.llm.common import DOCUMENT_COLUMNS, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorisation machine scores below its threshold."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs.select(*DOCUMENT_COLUMNS), model).where("predicted = 1").select(*DOCUMENT_COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a rule of the cascade rejects."""
    return rule_cascade.keep_good(docs.select(*DOCUMENT_COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate class."""
    return jaccard_join.keep_one(docs.select(*DOCUMENT_COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that stand in two places from the texts."""
    return suffix_dedup.dedup_documents(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    import public_tokenizers

    return curve_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality classifier", quality), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings), ("packing", packing),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the packing; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
