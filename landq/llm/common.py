"""Shared helpers of the training-data operators: tables, worker-wide values, Arrow batches, global order."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.session import shared_path

#: Rows or bytes after which a task hands its output on.
FLUSH_ROWS = 20_000
FLUSH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """A value that is made once in each Python worker and kept for its later tasks, until another one is wanted there."""
    kept = sys.__dict__.setdefault("_landq_llm", {})
    if key not in kept:
        kept.clear()  # workers go on to other operators; what those knew would only take their memory
        kept[key] = make()
    return kept[key]


def rows_of(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple]:
    """Rows of a batch as tuples, so many turned into Python values at a time."""
    for at in range(0, batch.num_rows, step):
        yield from zip(*(column.to_pylist() for column in batch.slice(at, step).columns), strict=True)


class Rows:
    """Collects output rows and gives them back as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= FLUSH_ROWS or self.bytes >= FLUSH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(self.schema)
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def task_number() -> int:
    return TaskContext.get().partitionId()


def numbered(df: DataFrame, order: list[Column], weight: Column | None = None, name: str = "order") -> DataFrame:
    """Adds ``global_start`` (weights of all rows before a row in the given order), stored in that order.

    Without ``weight`` every row weighs one, so it is the row's number from 0. Rows are dealt by range with a salt
    behind the order, so equal rows don't meet in one task; only one total per task is summed in one place.
    """
    ranged = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    ranged = ranged.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, F.col("_salt")]
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    schema = T.StructType([*ranged.schema, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, seen = task_number(), 0
        for batch in batches:
            weights = batch.column("_w").to_numpy(zero_copy_only=False)
            ends = np.cumsum(weights)
            local = seen + ends - weights
            seen += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(weights), part, np.int32)), pa.array(local.astype(np.int64))],
                names=[*batch.schema.names, "_part", "_local"],
            )

    return with_start(stored(ranged.mapInArrow(run, schema), name)).drop("_w")


def with_start(df: DataFrame) -> DataFrame:
    """``global_start`` from the number of the task that wrote a row, what the row weighs and what stood before it there.

    The broadcast has one row of two numbers for each task that wrote, so it stays small for any number of rows.
    """
    totals = df.groupBy("_part").agg(F.sum("_w").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    joined = df.join(F.broadcast(bases), "_part")
    return joined.withColumn("global_start", F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")
