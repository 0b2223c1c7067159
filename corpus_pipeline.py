"""A corpus from raw documents to token numbers: quality, exact copies, near copies, mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written and read again as the next one's docs, and
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanweave.llm import bpe, exact_dedup, mixing, ngram_join, quality
from scanweave.llm.common import stored
from scanweave.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeated as it repeats them; those that it doesn't draw go."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of token numbers and of the text decoded from them, one row for each repetition."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("mixing", mix_stage),
    ("tokens", token_stage),
]

#: The classifier, the similarity join and the tokenizer can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
