"""Ingest of contents that the archive does not hold yet, against an index of hashes in the shared folder.

The index holds one row of 32 bytes for each content, in buckets by the first bits of the hash. A trigger reads only the
buckets that its uploads fall into, and neither the archive nor a state that grows with all contents ever seen.
What a trigger adds is kept under its number, so a trigger that is run again sees what it saw before and replaces its
own results. Every ``COMPACT`` triggers the index is written anew, one file for each bucket; the generation before stays
for a trigger that is run again, and the one before that goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKET_BITS = 8
COMPACT = 16
INDEX_DDL = "hash binary, batch long, bucket int"


def _file_system(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def _exists(spark: SparkSession, path: str) -> bool:
    files, location = _file_system(spark, path)
    return files.exists(location)


def _bucketed(hashes: DataFrame, bits: int) -> DataFrame:
    """hash and bucket, its first bits."""
    first = F.coalesce(F.conv(F.substring(F.hex("hash"), 1, 4), 16, 10).cast("int"), F.lit(0))  # null contents have no digits
    return hashes.select("hash", F.shiftright(first, 16 - bits).alias("bucket"))


class ContentIndex:
    """Hashes of all contents so far under ``path``/index; ``path``/table has what each trigger brought."""

    def __init__(self, spark: SparkSession, path: str, bucket_bits: int = BUCKET_BITS, compact: int = COMPACT):
        self.spark, self.path, self.bits, self.compact = spark, path, bucket_bits, compact

    def generation(self, batch: int) -> int:
        return batch // self.compact * self.compact

    def folder(self, generation: int) -> str:
        return f"{self.path}/index/generation={generation}"

    def _put(self, hashes: DataFrame, generation: int, batch: int) -> None:
        """Write hashes as one batch of a generation; doing so again replaces it."""
        dealt = hashes.repartition("bucket").sortWithinPartitions("bucket", "hash")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder(generation)}/batch={batch}")

    def start(self, history: DataFrame | None) -> None:
        """The first generation: the hashes of the archive, column ``sha256`` of hex digits. Done once."""
        if _exists(self.spark, f"{self.folder(0)}/batch=-1/_SUCCESS"):
            return
        hashes = self.spark.createDataFrame([], "hash binary") if history is None else history.select(F.unhex("sha256").alias("hash")).distinct()
        self._put(_bucketed(hashes, self.bits), 0, -1)

    def before(self, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """Hashes known before a trigger, of all buckets or of some: files of other buckets are not read."""
        held = self.spark.read.schema(INDEX_DDL).parquet(self.folder(self.generation(batch))).filter(F.col("batch") < batch)
        return held if buckets is None else held.filter(F.col("bucket").isin(buckets))

    def merge(self, uploads: DataFrame, batch: int) -> None:
        """Keep the uploads of a trigger whose content is new, one for each content, and add their hashes."""
        generation = self.generation(batch)
        if batch == generation and batch:
            old = self.spark.read.schema(INDEX_DDL).parquet(self.folder(generation - self.compact))
            self._put(old.select("hash", "bucket"), generation, -1)
            files, location = _file_system(self.spark, self.folder(generation - 2 * self.compact))
            if generation >= 2 * self.compact:
                files.delete(location, True)
        hashed = uploads.withColumn("hash", F.unhex("sha256"))
        found = _bucketed(hashed, self.bits).select("bucket").distinct().collect()  # no more than there are buckets
        known = self.before(batch, [r["bucket"] for r in found]).select("hash")
        fresh = hashed.dropDuplicates(["hash"]).join(known, "hash", "left_anti").drop("hash")
        target = f"{self.path}/table/batch={batch}"
        fresh.write.mode("overwrite").parquet(target)
        self._put(_bucketed(self.spark.read.parquet(target).select(F.unhex("sha256").alias("hash")), self.bits), generation, batch)


def ingest_new(
    uploads: DataFrame, content: str, path: str, history: DataFrame | None = None, bucket_bits: int = BUCKET_BITS, compact: int = COMPACT
) -> StreamingQuery:
    """Start a run over the uploads that are there now; ``path``/table gets those whose content is new, with ``sha256``.

    Which of several uploads of one content in a trigger stays is left open; null is a content like any other. Nothing
    is late and nothing is forgotten. Contents of ``history`` (its ``sha256``) are known from the start.
    """
    spark = uploads.sparkSession
    index = ContentIndex(spark, path, bucket_bits, compact)
    index.start(history)
    hashed = uploads.withColumn("sha256", F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")))
    spark.createDataFrame([], hashed.schema).write.mode("ignore").parquet(f"{path}/table/batch=-1")
    stream = hashed.writeStream.foreachBatch(lambda df, batch: ContentIndex(df.sparkSession, path, bucket_bits, compact).merge(df, batch))
    return stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """What ingest_new has kept so far; ``sha256`` is null for null contents."""
    return spark.read.parquet(f"{path}/table").drop("batch").withColumn("sha256", F.nullif("sha256", F.lit("")))
