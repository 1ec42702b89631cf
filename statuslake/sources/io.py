"""Sources and sinks; every path may be on any file system that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, pattern: str | None = None, with_file: bool = False) -> DataFrame:
    """A Parquet folder (hive partitions become columns), perhaps only files that match, perhaps with their names."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)
    return df.withColumn("filename", F.col("_metadata.file_path")) if with_file else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    import tempfile

    return "file://" + tempfile.gettempdir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_names(spark: SparkSession, path: str, partition: str = "release") -> list[str]:
    """The releases under a prefix, the newest first, from the names of its folders alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in files if f.isDirectory()]
    return sorted((n.split("=", 1)[1] for n in names if n.startswith(f"{partition}=")), reverse=True)


def newest_release(spark: SparkSession, path: str, partition: str = "release") -> DataFrame:
    """The rows of the newest release's folder; no other is opened."""
    names = release_names(spark, path, partition)
    if not names:
        raise ValueError(f"no release under {path}")
    return release(spark, path, names[0], partition)


def release(spark: SparkSession, path: str, name: str, partition: str = "release") -> DataFrame:
    """The rows of one release; unknown ones, and those whose writer hasn't finished, are refused."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise ValueError(f"unknown release {name}; there are {release_names(spark, path, partition)}")
    done = [spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS") for f in (folder, folder.getParent())]
    if not any(files.exists(f) for f in done):
        raise ValueError(f"release {name} is not complete")
    return spark.read.parquet(folder.toString())


def latest_release(df: DataFrame, partition: str = "release") -> DataFrame:
    """Rows of the newest release; the value is looked up first, so the filter prunes partitions."""
    newest = df.agg(F.max(partition)).first()[0]
    return df.where(F.col(partition) == F.lit(newest))


def releases(df: DataFrame, partition: str = "release") -> DataFrame:
    return df.select(partition).distinct().orderBy(F.desc(partition))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines with declared columns; blank and malformed lines are left out, or fail if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def geojson(spark: SparkSession, path: str, properties: str, points_only: bool = False) -> DataFrame:
    """Features of GeoJSON collections: the declared properties, has_geometry, lon and lat."""
    geometry = "struct<type: string, coordinates: array<double>>"
    rows = spark.read.schema(f"features array<struct<type: string, properties: struct<{properties}>, geometry: {geometry}>>").option("multiLine", True).json(path)
    each = rows.select(F.explode("features").alias("f"))
    point = F.col("f.geometry.type") == "Point"
    out = each.select("f.properties.*", F.col("f.geometry").isNotNull().alias("has_geometry"), F.when(point, F.get("f.geometry.coordinates", F.lit(0))).alias("lon"), F.when(point, F.get("f.geometry.coordinates", F.lit(1))).alias("lat"))
    return out.where("lon IS NOT NULL AND lat IS NOT NULL") if points_only else out


def geojson_lines(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features written one to a line."""
    rows = spark.read.schema(f"type string, properties struct<{properties}>, geometry struct<type: string, coordinates: array<double>>").json(path)
    return rows.select("properties.*", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


def register_release(df: DataFrame, release: str) -> str:
    name = "place_" + release.replace("-", "_").replace(".", "_")
    df.createOrReplaceTempView(name)
    return name


def describe_schema(df: DataFrame) -> DataFrame:
    """(name, type) of each column."""
    return df.sparkSession.createDataFrame([(n, t) for n, t in df.dtypes], "name string, type string")


def schema_profile(df: DataFrame) -> DataFrame:
    """(name, type, n, filled) of each column: rows, and those with a value."""
    cells = [F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.count("*").alias("n"), F.count(F.col(f"`{n}`")).alias("filled")) for n, t in df.dtypes]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def write_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)


def write_json_lines(df: DataFrame, path: str, label: int | None = None) -> None:
    """JSON lines, with ``open`` set to a label if one is given."""
    (df if label is None else df.withColumn("open", F.lit(label))).write.option("ignoreNullFields", False).json(path)


def as_features(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """(value): each row as the text of a GeoJSON Feature."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    """A feature on each line, as ``geojson_lines`` reads them."""
    as_features(df, lon, lat, properties).write.text(path)


def write_collections(df: DataFrame, path: str, lon: str, lat: str, properties: list[str], file_rows: int = 100_000) -> None:
    """Feature collections of about ``file_rows`` features each, one to a file, a feature on each line."""
    files = max(1, -(-df.count() // file_rows))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda values: pa.RecordBatch.from_arrays([values], ["value"])
        yield lines(pa.array(['{"type":"FeatureCollection","features":[']))
        first = True
        for batch in batches:
            values = batch.column(0)
            if first and len(values):
                yield lines(values.slice(0, 1))
                values, first = values.slice(1), False
            yield lines(pc.binary_join_element_wise(pa.scalar(",", values.type), values, pa.scalar("", values.type)))
        yield lines(pa.array(["]}"]))

    as_features(df, lon, lat, properties).repartition(files).mapInArrow(collect, "value string").write.text(path)


def ids(df: DataFrame, key: str = "id") -> DataFrame:
    """The distinct ids of a table, as the right side of a semi- or anti-join."""
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def hex_binaries(df: DataFrame) -> DataFrame:
    """Binary columns as lower-case hexadecimal text."""
    return df.withColumns({f.name: F.lower(F.hex(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)})


def normalised(df: DataFrame, label: int | None = None) -> DataFrame:
    """Not-a-number as null, null lists as empty ones, missing confidence as 0; with the label, if one is given."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
            out[f.name] = F.coalesce(c, F.lit(0.0).cast(f.dataType)) if f.name == "confidence" else c
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name == "categories" and isinstance(f.dataType, T.StructType):
            out[f.name] = F.coalesce(c, F.struct(*[F.lit(None).cast(x.dataType).alias(x.name) for x in f.dataType.fields]))
    if label is not None:
        out["open"] = F.lit(label)
    return df.withColumns(out)


def save_tables(path: str, **tables: DataFrame) -> None:
    """Splits, encoders and classifier states as Parquet tables of one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
