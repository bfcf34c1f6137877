"""Token ids as Parquet list columns, laid out for selective reads.

One row is one document, in ascending doc_id order over all files. Token lists are dictionary-encoded (an id takes as
many bits as the ids of its page need), the sorted columns beside them delta-encoded. Row groups and pages are small
enough that the page indexes let a reader fetch the tokens of a few documents, and metadata reads never touch tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import rows_of, table, task_number, with_start
from landq.llm.vocabulary import WordEncoder, encoder, packed
from landq.session import shared_path

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
FILE_DDL = "doc_id long, _part int, _local long, _w long, tokens array<int>"
#: Row groups of 16 MB, pages of 64 KB or 512 rows; version 2 pages carry delta encodings, the page indexes come with them.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#_local": "false",
    "parquet.enable.dictionary#_w": "false",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Encode whole texts (null: empty), append the end id, and write them under ``path`` in ascending doc_id order.

    Rows of one doc_id are ordered by a hash of their text; a null doc_id comes first. The order is dealt by range with
    a salt behind it, so a doc_id with very many rows spreads over tasks. Other columns don't pass.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    named = docs.select("doc_id", "text", keys[1].alias("_h"), keys[2].alias("_s"))
    ordered = [keys[0], F.col("_h"), F.col("_s")]
    ranged = named.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, part, end, seen = encoder(WordEncoder, vocabulary).encode, task_number(), packed([END_ID]), 0
        for batch in batches:
            step = 1000
            for at in range(0, batch.num_rows, step):
                few = batch.slice(at, step)
                coded = [encode(text or "") + end for _, text in rows_of(few)]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                values = np.frombuffer(b"".join(coded), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column(0),
                        pa.array(np.full(len(coded), part, np.int32)),
                        pa.array(seen + offsets[:-1].astype(np.int64)),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ],
                    names=["doc_id", "_part", "_local", "_w", "tokens"],
                )
                seen += int(offsets[-1])

    ranged.mapInArrow(run, FILE_DDL).write.options(**LAYOUT).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; reads no tokens."""
    files = spark.read.schema(FILE_DDL).parquet(path)
    return with_start(files.drop("tokens")).select("doc_id", F.col("global_start").alias("start"), F.col("_w").alias("n_tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens. A filter on doc_id skips row groups and pages by their indexes."""
    files = with_start(spark.read.schema(FILE_DDL).parquet(path))
    return files.select("doc_id", F.col("global_start").alias("start"), F.col("_w").alias("n_tokens"), "tokens")


def digest(tokens: DataFrame) -> DataFrame:
    """ids_crc32 of each document's ids as little-endian unsigned 32-bit integers, instead of the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            lists = batch.column("tokens")
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = 4 * lists.offsets.to_numpy()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digest(read_tokens(spark, path))
