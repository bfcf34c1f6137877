"""Readers: record documents, cadastre, binary uploads, tables of the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.schemas import PARCEL_FEATURES, RECORD


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extracted record documents (one JSON object per file), the schema given and never inferred."""
    raw = spark.read.schema(RECORD).option("multiLine", True).json(path)
    return raw.select(F.col("image_hash").alias("document_id"), "extraction", "agreements")


def parcels_from_features(collections: DataFrame) -> DataFrame:
    """Feature collections to one row per parcel; ord is the place in the collection."""
    rows = collections.select(F.posexplode("features").alias("pos", "f"))
    ring = F.transform(
        F.get("f.geometry.coordinates", F.lit(0)),
        lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")),
    )
    return rows.select(F.col("pos").cast("long").alias("ord"), "f.properties.*", ring.alias("ring"))


def read_cadastre(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON file is one JSON value, so it is read once and kept as Parquet (``write_parcels``)."""
    return parcels_from_features(spark.read.schema(PARCEL_FEATURES).option("multiLine", True).json(path))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as content, path, ts for content-addressed ingest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content", "path", F.col("modificationTime").alias("ts"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
