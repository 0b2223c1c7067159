"""Registered queries of this subpackage and the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanweave.llm import (
    ann, bpe, exact_dedup, lexical, line_dedup, merkle, mixing, ngram_join, ngram_lm, quality, secrets, sharding, substrings,
)

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op1_bpe")
def op1(spark, sf_dir):
    return bpe.digests(_documents(spark, sf_dir), tokenizer_path())


@_query("op2_ngram_join")
def op2(spark, sf_dir):
    return ngram_join.near_duplicates(_documents(spark, sf_dir))


@_query("op3_ngram_lm")
def op3(spark, sf_dir):
    return ngram_lm.score(_documents(spark, sf_dir))


@_query("op4_line_dedup", line_dedup.SQL)
def op4(spark, sf_dir):
    return line_dedup.line_report(_documents(spark, sf_dir))


@_query("op5_exact_dedup", exact_dedup.SQL)
def op5(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


@_query("op6_mixing", mixing.SQL)
def op6(spark, sf_dir):
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@_query("op7_quality")
def op7(spark, sf_dir):
    return quality.classify(_documents(spark, sf_dir))


@_query("op8_ann")
def op8(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


@_query("op9_kd_shards")
def op9(spark, sf_dir):
    return sharding.shard(_documents(spark, sf_dir))


@_query("op10_secrets")
def op10(spark, sf_dir):
    return secrets.secret_report(_documents(spark, sf_dir))


@_query("op11_substring_dedup", substrings.SQL)
def op11(spark, sf_dir):
    return substrings.substring_report(_documents(spark, sf_dir))


@_query("op12_merkle", merkle.SQL)
def op12(spark, sf_dir):
    return merkle.merkle_report(_documents(spark, sf_dir))


@_query("op13_lexical_search", lexical.SQL)
def op13(spark, sf_dir):
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
