"""Structured Streaming: classifier state from arriving batches, scoring of arrivals, and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import classify


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored states, the newest last."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    done = [n for n in names if n.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def update_state(stream: DataFrame, path: str, checkpoint: str, vector: str = "v", label: str = "label", keep: int = 3) -> StreamingQuery:
    """Every micro-batch merges its part into the state before it and writes the whole state under its batch id.

    The state is as large as its classes, however many batches there were: a version holds all before it, and only the last
    ``keep`` stay.  A repeated batch starts from the version before its own, so it changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = [n for n in versions(spark, path) if n < number]
        part = classify.da_fit(batch, vector, label)
        if known:
            part = classify.da_merge(spark.read.parquet(f"{path}/version={known[-1]}").unionByName(part))
        part.write.mode("overwrite").parquet(f"{path}/version={number}")
        for old in known[: max(0, len(known) - keep + 1)]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored state: one version, a row for each class."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}").select("label", "n", "mean", "scatter")


def score_stream(stream: DataFrame, state: DataFrame, vector: str = "v") -> DataFrame:
    """Arrivals with the nearest class mean's prediction; the state is a broadcast row."""
    return classify.predict(classify.ncm_proba(stream, state.select("label", "n", "mean"), vector))


def seen_once(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first arrival of each key, remembered for ``delay``."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
