"""What the operators of this subpackage share on the cluster: durable tables and connected components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from ``spark.checkpoint.dir``; a temporary one only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or _own_dir()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="statuslake-")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    The files stay until the folder is cleared: a returned DataFrame may still read them.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def write_table(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


#: A key is hot if it holds more than one in so many rows; there are fewer hot keys than this.
HOT = 1000


def join_members(rows: DataFrame, classes: DataFrame, on: list[str], members: str = "members") -> DataFrame:
    """``rows`` joined with ``classes``, which has a row for each key with the number of its rows in ``members``.

    The classes of hot keys, fewer than ``HOT`` at any size, are broadcast; all others meet their rows by a shuffle, so no
    task gets more than a thousandth of the rows for one key.  ``rows`` is read twice and should be a written table.
    """
    total = classes.agg(F.sum(members)).first()[0] or 0
    hot = F.broadcast(classes.where(F.col(members) * HOT > total))
    rest = rows.join(hot.select(*on), on, "left_anti").join(classes.where(F.col(members) * HOT <= total), on)
    return rows.join(hot, on).unionByName(rest)


#: Rows of an Arrow batch: whole texts, of a few kilobytes mostly, in the JVM and in the Python worker at once.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, and keeps batches of texts small in the session."""
    context = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(limit)) <= BATCH_ROWS:
        spark.conf.set(limit, BATCH_ROWS)
    if getattr(context, "_statuslake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="statuslake-")), "statuslake_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted((root / "statuslake").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(path)
    context._statuslake_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that can be reached.

    Each round every node points to its smallest neighbour or itself, pointers are followed once more, and edges are
    contracted to what they point at.  A node with many edges costs nothing extra: minima are combined before the
    shuffle.  Edges shrink every round until none is left; nothing is collected.  Null ends are ignored.  ``edges`` is
    read more than once, so it should be a written table.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    labels, number = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("id"), "p")
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        parent = durable(parent.join(up, "p").select("id", F.col("pp").alias("p")), f"parents{number}")
        at = lambda c: parent.select(F.col("id").alias(c), F.col("p").alias(f"{c}_p"))  # noqa: E731, B023
        edges = durable(edges.join(at("a"), "a").join(at("b"), "b").where("a_p <> b_p").select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).distinct(), f"edges{number}")
        if labels is None:
            labels = parent.select("id", F.col("p").alias("component"))
        else:
            moved = parent.select(F.col("id").alias("component"), "p")
            labels = durable(labels.join(moved, "component", "left").select("id", F.coalesce("p", "component").alias("component")), f"labels{number}")
        number += 1
    if labels is None:
        kind = dict(edges.dtypes)["a"]
        return spark.createDataFrame([], f"id {kind}, component {kind}")
    return labels
