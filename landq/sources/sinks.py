"""Writers. Each writes in parallel, one file per partition, and can be repeated without doubling rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.functions.text import spread
from landq.operators.review import correction_messages
from landq.operators.rules import HASHED


def write_stage(df: DataFrame, path: str, batch_date: str) -> None:
    """Replace this batch's partition of a stage table and leave the others alone."""
    (
        df.withColumn("batch_date", F.lit(batch_date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_date")
        .parquet(path)
    )


def write_parcels(parcels: DataFrame, path: str) -> None:
    parcels.write.mode("overwrite").partitionBy("district").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def features(rows: DataFrame, parcels: DataFrame) -> DataFrame:
    """One GeoJSON feature per line: properties and the ring of the matched parcel, or a null geometry.

    ``rows`` carry ord, the matched parcel. Rows without one are spread, not gathered in a task; rings are not sent whole to
    every task.
    """
    own = [c for c in rows.columns if c != "ord"]
    rings = parcels.filter(F.col("ord").isNotNull()).select(spread(F.col("ord").cast("string"), "ord").alias("_ring_of"), "ring")
    keyed = rows.withColumn("_ord", spread(F.col("ord").cast("string"), own[0]))
    joined = keyed.join(rings.hint(HASHED), F.col("_ord") == F.col("_ring_of"), "left")
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    geometry = F.when(
        F.col("ring").isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    )
    properties = F.struct(*own)
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")
    )
    return joined.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson_lines(rows: DataFrame, parcels: DataFrame, path: str) -> None:
    features(rows, parcels).write.mode("overwrite").text(path)


def write_corrections(corrections: DataFrame, path: str) -> None:
    """Chat-format JSON lines, oldest first across and within the files."""
    lines = correction_messages(corrections).repartitionByRange("created_at", "event_id")
    lines.sortWithinPartitions("created_at", "event_id").select(F.col("line").alias("value")).write.mode(
        "overwrite"
    ).text(path)
