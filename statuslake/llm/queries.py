"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, cotraining, ctw, decontaminate, extraction, minhash, pii, sharding, token_files, url_lists, vectors
from .cluster import documents, ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise(documents(spark, sf_dir)).select("doc_id", "text", "n_entities")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: 8 shards of nearly equal bytes, equal texts together."""
    out = sharding.assign(documents(spark, sf_dir), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_lists.page_captures(pages), url_lists.page_events(pages))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digests(rows, conversations.damaged(rows))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def shipped(query: Query) -> Query:
    """``query`` after the package has been sent to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


ALL = (op1_token_files, op2_cotraining, op3_pii, op4_minhash, op5_decontaminate, op6_ctw, op7_shards, op8_vectors, op9_bpe, op10_url_lists, op11_conversations, op12_alignment, op13_extraction)
QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in ALL}
#: The others hash, fit or write files; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_minhash": minhash.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op8_vectors": vectors.ORACLE, "op10_url_lists": url_lists.ORACLE}
