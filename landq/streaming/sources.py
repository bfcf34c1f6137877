"""Streaming readers over directories of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, directory: str, name: str, trigger_bytes: int = 4_000_000_000) -> DataFrame:
    """One table of a directory as a stream; the schema comes from the files' footers, once.

    A table is a folder of files or a single file; both are read in full, and a table without files is an error.
    The bytes per trigger bound what the stateful jobs have to put in order per key at a time.
    """
    path = f"{directory.rstrip('/')}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    status = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(location)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", trigger_bytes)
    if status.isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; the files hold UTC without one."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
