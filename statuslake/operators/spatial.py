"""Band, radius and grid joins over points by cells.

A band join in two dimensions is an equi-join on grid cells: the left side is put into its cell, the right side into its
own and the eight around it, and the exact condition decides.  Cells are as wide as the band, so nothing is missed, and
adaptive execution splits crowded cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import METRES_LAT, REFERENCE_LAT, distance_metres

#: Ids in one row of a spot; two rows make the square of it at once.
SPOT_IDS = 128
#: More partitions than there are.
ALL_PARTS = 1 << 30


def _cells(x: Column, y: Column, dx: float, dy: float) -> tuple[Column, Column]:
    return F.floor(x / dx).cast("bigint"), F.floor(y / dy).cast("bigint")


def degrees(metres: float) -> tuple[float, float]:
    """What ``metres`` are of longitude and of latitude, rounded up."""
    return metres / (METRES_LAT * math.cos(math.radians(REFERENCE_LAT))) * (1 + 1e-9), metres / METRES_LAT * (1 + 1e-9)


def cell_join(left: DataFrame, right: DataFrame, dlon: float, dlat: float, equal: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Pairs whose points lie in the same or neighbouring cells; both sides have lon and lat, the right's get ``r_``.

    ``equal``: columns of the right, with their ``r_``, that the left has, too, and that must be the same.  ``parts``: into
    how many tasks cells are dealt whatever their size, for pairs that are many times the rows.
    """
    around = F.explode(F.expr("transform(sequence(0, 8), i -> struct(CAST(i % 3 - 1 AS BIGINT) AS dx, CAST(i DIV 3 - 1 AS BIGINT) AS dy))"))
    cx, cy = _cells(F.col("lon"), F.col("lat"), dlon, dlat)
    a = left.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_cx", cx).withColumn("_cy", cy)
    b = right.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("_cx", cx).withColumn("_cy", cy).withColumn("_d", around)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], (F.col("_cx") + F.col("_d.dx")).alias("_cx"), (F.col("_cy") + F.col("_d.dy")).alias("_cy"))
    keys = ["_cx", "_cy", *(equal or [])]
    if parts:
        a, b = a.repartition(parts, *keys), b.repartition(parts, *keys)
    return a.join(b, keys).drop("_cx", "_cy")


def band_join(left: DataFrame, right: DataFrame, delta: float, parts: int | None = None) -> DataFrame:
    """Pairs within ``delta`` degrees in both directions."""
    near = (F.abs(F.col("lon") - F.col("r_lon")) <= delta) & (F.abs(F.col("lat") - F.col("r_lat")) <= delta)
    return cell_join(left, right, delta * (1 + 1e-9), delta * (1 + 1e-9), parts=parts).where(near)


def radius_join(left: DataFrame, right: DataFrame, metres: float, equal: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Pairs within ``metres``, with their distance ``dist_m``; ``equal`` and ``parts`` as in ``cell_join``."""
    dlon, dlat = degrees(metres)
    x, y = (F.col("lon") - F.col("r_lon")) / dlon, (F.col("lat") - F.col("r_lat")) / dlat
    d = distance_metres(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    # the squares, cheaper than a root, dismiss two pairs of three
    met = cell_join(left, right, dlon, dlat, equal, parts).where(x * x + y * y <= 1 + 1e-6)
    return met.withColumn("dist_m", d).where(F.col("dist_m") <= metres)


def spots(points: DataFrame) -> DataFrame:
    """(lon, lat, ids): the ids of the points at each spot, a crowded spot in rows of ``SPOT_IDS`` of them."""
    known = points.where("lon IS NOT NULL AND lat IS NOT NULL").select("id", "lon", "lat")
    place = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("id"))
    return known.withColumn("_part", F.floor((place - 1) / SPOT_IDS)).groupBy("lon", "lat", "_part").agg(F.collect_list("id").alias("ids")).drop("_part")


def expanded(met: DataFrame) -> DataFrame:
    """A row for each pair of points of two ``spots`` that met: id and r_id instead of ids and r_ids.

    Spots meet once, whatever is computed of a pair is computed once, and only the result has a row for each pair of ids.
    A join's loop holds all rows that it makes of one left row before it hands them on.  So ids are exploded behind a
    step that ends the loop (partitions stay as they are): it holds spots, not pairs of ids, which grow with the square.
    """
    met = met.coalesce(ALL_PARTS)
    return met.withColumn("r_id", F.explode("r_ids")).withColumn("id", F.explode("ids")).drop("ids", "r_ids")


def many_parts(df: DataFrame) -> int:
    """Tasks for a result many times its input."""
    return 8 * max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def grid_centres(df: DataFrame, box: tuple[float, float, float, float], steps: int) -> DataFrame:
    """(cell, lon, lat): the centres of steps x steps cells of a box (xmin, xmax, ymin, ymax)."""
    w, h = (box[1] - box[0]) / steps, (box[3] - box[2]) / steps
    ids = df.sparkSession.range(steps * steps).withColumnRenamed("id", "cell")
    return ids.select("cell", (F.lit(box[0]) + (F.col("cell") % steps + 0.5) * w).alias("lon"), (F.lit(box[2]) + (F.floor(F.col("cell") / steps) + 0.5) * h).alias("lat"))


def sweep(centres: DataFrame, points: DataFrame, metres: float, limit: int = 50) -> DataFrame:
    """Points within ``metres`` of each centre, the ``limit`` nearest of each, once each with the first cell that found it."""
    found = radius_join(centres, points, metres)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("dist_m", "r_id"))
    kept = found.withColumn("_rn", place).where(F.col("_rn") <= limit)
    return kept.groupBy(F.col("r_id").alias("id")).agg(F.min("cell").alias("first_cell"), F.count("*").alias("found_by"))
