"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage sees all rows that its predecessor kept and returns the columns of ``documents``, further ones included; the
last returns token ids.  Defined results, the same in all stages: an empty table gives an empty table; whole texts are
read, however long; a null text counts as the empty one; a null doc_id is an id like any other; rows that share an id
are rows of their own, and only those of equal text, too, are repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuslake.llm import bpe, cotraining, decontaminate, minhash, pii
from statuslake.llm.cluster import documents, durable, join_members, ship

#: A document stays if it is this likely to be good; below one half, so that clean documents stay.
QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; all of them if no label names one. Repeats fare alike."""
    ship(spark)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs, model, QUALITY_THRESHOLD).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles at a similarity of 0.8: the smallest id.

    Every row is a document of its own, whatever its id: of rows of one id those that aren't near-duplicates all stay.
    A null id counts as the greatest.  Null and blank texts are near-duplicates of nothing.
    """
    ship(spark)
    row = "pipeline_row"
    while row in docs.columns:
        row += "_"
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    found = found.select(F.col("doc_id").alias(row), "component_id")
    known = durable(rows.select(row, "doc_id").join(found, row), "components")
    smallest = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row))
    groups = durable(known.groupBy("component_id").agg(smallest.alias("stays"), F.count("*").alias("members")).where("members > 1"), "groups")
    gone = durable(join_members(known, groups, ["component_id"]).where(F.col(row) != F.col("stays")).select(row), "gone")
    gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten benchmark words occurs; all of them if the benchmark is empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars``, if there is one, follows the new text."""
    out = pii.anonymise(docs).select(*docs.columns)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kinds["n_chars"]))) if "n_chars" in kinds else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each whole text; no ids for null and empty texts."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("surrogates", surrogates), ("bpe_encoding", encoding)]
#: The stages fit a model, hash and draw surrogates: no SQL form. Tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    return docs
