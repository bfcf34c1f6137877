"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys stand on a ring by the hash of their doc_id; every shard has many virtual nodes there, and a key belongs to the
next node clockwise. A shard takes no more than its bound: what overflows continues clockwise to the next node of a
shard with room. Bounds that differ by one at most and add up to all rows make the law ``rows``.

Only numbers of rows matter to who overflows where, so the walk around the ring runs over the arcs between nodes, of
which there are ``shards * nodes``, whatever the number of rows. It yields cuts in the ring's order, and each
row finds its shard and its slot by its number in that order. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import numbered, table

SHARDS = 24
NODES = 128
RESULT_DDL = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def ring(shards: int = SHARDS, nodes: int = NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; positions are signed 64-bit."""

    def position(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{shard}:{node}".encode()).digest()[:8], "big", signed=True)

    return sorted((position(s, n), s) for s in range(shards) for n in range(nodes))


def walk(loads: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """Runs (first, until, shard, slot_base) of row numbers in ring order.

    ``loads[i]`` rows stand on the arc that ends at node i of shard ``owners[i]``. First every arc fills its own shard
    up to the bound, then what is left of each continues clockwise to shards that still have room.
    """
    room, left, starts, taken = list(bounds), [], [], []
    at = 0
    for load, shard in zip(loads, owners, strict=True):
        here = min(load, room[shard])
        room[shard] -= here
        taken.append((at, at + here, shard))
        starts.append(at + here)
        left.append(load - here)
        at += load
    for i, rest in enumerate(left):
        step = i
        while rest:
            step = (step + 1) % len(owners)
            here = min(rest, room[owners[step]])
            if here:
                room[owners[step]] -= here
                taken.append((starts[i], starts[i] + here, owners[step]))
                starts[i] += here
                rest -= here
    runs, filled = [], [0] * len(bounds)
    for first, until, shard in sorted(taken):
        if until > first:
            runs.append((first, until, shard, filled[shard]))
            filled[shard] += until - first
    return runs


def shard_rows(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents.

    Null text has size 8 and the checksum of nothing; a null doc_id has its own place on the ring. Rows of one doc_id
    stand in a row on the ring, ordered by size and checksum, and may be cut anywhere; equal rows are interchangeable.
    An empty table gives no rows. Other columns don't pass.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("position"),
    )
    order = [F.col("position"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    placed = numbered(rows, order, name="ring")
    points = ring(shards, nodes)
    ends, owners = [p for p, _ in points], [s for _, s in points]
    # keys behind the last node go to the first; one row for each arc at most reaches the driver
    counts = dict(tuple(r) for r in _arcs(placed, ends).groupBy("arc").agg(F.sum("n")).collect())
    loads = [counts.get(i, 0) for i in range(len(ends) + 1)]
    total = sum(loads)
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    return _placed(placed, walk(loads, [*owners, owners[0]], bounds))


def _arcs(placed: DataFrame, ends: list[int]) -> DataFrame:
    """Number of rows on each arc, counted batch by batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.zeros(len(ends) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(ends, batch.column(0).to_numpy(zero_copy_only=False))
            counts += np.bincount(at, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["arc", "n"])

    return placed.select("position").mapInArrow(run, "arc long, n long")


def _placed(placed: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        first, _, shard, base = np.array(runs, np.int64).reshape(-1, 4).T
        for batch in batches:
            number = batch.column(3).to_numpy(zero_copy_only=False)
            at = np.searchsorted(first, number, side="right") - 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(["rows"] * n, pa.string()),
                    pa.array(shard[at].astype(np.int32)),
                    pa.array(base[at] + number - first[at]),
                    pa.nulls(n, pa.int32()),
                ],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    return placed.select("doc_id", "size", "text_crc32", "global_start").mapInArrow(run, RESULT_DDL)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
