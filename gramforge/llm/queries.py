"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import minhash, mixing, nearcopies, packing, quality, sharding, simhash, suffix_dedup, tokencount, toxicity, urlfilter
from .common import cut, documents


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine; executors have the same library."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(documents(spark, sf_dir)).select("doc_id", "bytes", "shard", "depth", "part", "shard_bytes")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(documents(spark, sf_dir))


def minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 6: bands joined and verified, over all documents; a row a document with its class."""
    return nearcopies.report(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer("word_bpe_49k.json")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(mixing.sized(documents(spark, sf_dir)).select("doc_id", "source", "size"))
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = urlfilter.captures(spark, sf_dir)
    return urlfilter.judge(captures, urlfilter.intervals(urlfilter.derived_lists(captures)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_minhash": op6_minhash,
        "minhash_near_copies": minhash_near_copies,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_url_filters": op9_url_filters,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": sharding.shard_sql(),
        "op9_url_filters": urlfilter.URL_SQL,
        "op10_quality": quality.QUALITY_SQL,
    }
