"""Packing of documents into training sequences: best-fit decreasing over the whole corpus.

Documents are encoded and cut; full windows stand alone. The rest is packed by best-fit decreasing: lengths in falling
order, each piece into the tightest open window that still takes it. Windows with the same room and pieces of the same
length are interchangeable, so the plan is made for the histogram of lengths (at most one entry for each length below
the window): a segment tree indexed by remaining capacity finds the tightest open windows, and whole runs of them
are filled at once. That is the same packing as piece by piece, for any number of pieces, and the driver sees only
the histogram. Each piece finds its place by its number among the pieces of its length.

A run of windows with room r takes r // L pieces of length L each and keeps less than half of its room, so it is
touched at most log2(window) times and the plan has at most about ``6 * window * log2(window)`` rows: a proven bound
for its broadcast.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landq.llm.common import Rows, rows_of, stored, table, task_number
from landq.llm.vocabulary import ByteEncoder, encoder, packed

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
PIECE = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("nth", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECE_DDL = "part int, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, nth long, ids binary"
PLAN_DDL = "length long, first long, until long, each long, sequence long, base long"


class Room:
    """Segment tree over remaining capacities: which smallest capacity of at least some size has open windows."""

    def __init__(self, window: int):
        self.leaves = 1
        while self.leaves <= window:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _count(self, capacity: int, step: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += step
            at //= 2

    def put(self, capacity: int, run: tuple[int, int]) -> None:
        """Windows numbered from run[0] up to run[1], each with this capacity left."""
        self.runs[capacity].append(run)
        self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.runs[capacity].pop()

    def tightest(self, size: int) -> int | None:
        """Smallest capacity of at least ``size`` with an open window."""
        at = self.leaves + size
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Plan for so many pieces of each length: (length, first, until, each, sequence, base).

    Pieces ``first`` to ``until`` of a length go into sequences from ``sequence`` on, ``each`` of them side by side
    in one, the first of these at offset ``base``.
    """
    room, plan, opened = Room(window), [], 0
    for length in sorted(counts, reverse=True):
        done, count = 0, counts[length]
        while done < count:
            capacity = room.tightest(length)
            if capacity is None:
                capacity = window
                wanted = -(-(count - done) // (window // length))
                run = (opened, opened + wanted)
                opened += wanted
            else:
                run = room.take(capacity)
            each = capacity // length
            full = min(run[1] - run[0], (count - done) // each)
            if full:
                plan.append((length, done, done + full * each, each, run[0], window - capacity))
                done += full * each
                if capacity - each * length:
                    room.put(capacity - each * length, (run[0], run[0] + full))
            rest = run[0] + full
            if rest < run[1]:
                some = count - done
                if 0 < some < each:
                    plan.append((length, done, count, some, rest, window - capacity))
                    done = count
                    room.put(capacity - some * length, (rest, rest + 1))
                    rest += 1
                if rest < run[1]:
                    room.put(capacity, (rest, run[1]))
    return plan


def cut(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """Documents as pieces of at most a window, with their ids; ``nth`` counts a task's pieces of one length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, end = encoder(ByteEncoder, vocabulary).encode, task_number(), packed([END_ID])
        seen, out = [0] * (window + 1), Rows(PIECE)
        for batch in batches:
            for doc_id, text in rows_of(batch):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    n = len(piece) // 4
                    out.add((part, doc_id, start, n, total, zlib.crc32(piece), seen[n], piece), len(piece))
                    seen[n] += 1
                if out.full():
                    yield out.take()
        yield out.take()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_DDL)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """All documents as pieces with their place: sequence_id and offset, besides the columns of ``cut``.

    Null text counts as empty (one piece, the end id); null and repeated doc_ids are rows like others. Pieces of equal
    length are interchangeable, so ties go by task and row. An empty table gives no rows. Other columns don't pass.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, vocabulary, window), "pieces", compression="zstd")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts, "lengths")
    # at most one row for each length reaches the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit(histogram, window), PLAN_DDL)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_nth"))
    placed = pieces.join(bases, ["part", "length"]).withColumn("number", F.col("base_nth") + F.col("nth"))
    place = plan.withColumnRenamed("length", "plan_length")
    found = placed.join(
        F.broadcast(place),
        (F.col("length") == F.col("plan_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("until")),
    )
    within = F.col("number") - F.col("first")
    return found.select(
        *(c for c in PIECE.names if c not in ("part", "nth")),
        (F.col("sequence") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (within % F.col("each")) * F.col("length")).alias("offset"),
    )


def sequences(packed_pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (padded to the window), lengths of the documents' pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    gathered = packed_pieces.groupBy("sequence_id").agg(parts.alias("parts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        schema = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            out = Rows(schema)
            for sequence, pieces in rows_of(batch):
                ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").astype(np.int32)
                ids = np.pad(ids, (0, window - len(ids)), constant_values=pad)
                out.add((sequence, ids, [p["length"] for p in pieces]))
            yield out.take()

    return gathered.mapInArrow(run, "sequence_id long, ids array<int>, lengths array<long>")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    return pack(table(spark, sf_dir, "documents")).select(*columns)
