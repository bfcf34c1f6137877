"""Continuous forms of rule checks, activity counts and event fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landq.operators import rules
from landq.operators.fanout import canonical_payload, match_subscriptions, outbox
from landq.session import shared_path
from landq.sources.rulebook import RuleBook

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of the jobs below lives in RocksDB: on disk, not in executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there now into a Parquet table in the shared folder, and read it back."""
    return run_with_state(stream, name, mode)[0]


def run_with_state(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, str]:
    """As run_to_table, with the folder of the stream's checkpoint, whose state can be read on."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), f"{path}/state"


# ---------------------------------------------------------------- checks


def identifier_checks(uploads: DataFrame) -> DataFrame:
    """Malformed identifiers of records as they arrive."""
    return rules.bad_identifiers(uploads)


def record_checks(uploads: DataFrame, book: RuleBook) -> DataFrame:
    """The rules that need nothing but the record itself, so they can run as records arrive."""
    return rules.record_rules(uploads, book)


# ---------------------------------------------------------------- activity


def activity_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events per window and kind, emitted once the watermark has passed the window."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), kind).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


# ---------------------------------------------------------------- fan-out


def fan_out(events: DataFrame, subscriptions: DataFrame, path: str, state: str) -> StreamingQuery:
    """Stream-static join into an outbox table. A repeated batch replaces its own partition only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        matched = match_subscriptions(batch, subscriptions)
        body = canonical_payload(
            F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.struct("event_id", "user_id")
        )
        (
            outbox(matched, body)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
