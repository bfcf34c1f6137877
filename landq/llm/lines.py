"""Removal of lines that many documents share, with two Bloom filters before anything is shuffled by line.

1. Tasks hash the keys of long lines, each once for a document, and deal the hashes to segments of the hash space. A
   segment has a filter of hashes seen once and a filter of hashes seen twice; both have a fixed size for a fixed
   number of lines, and the number of segments follows the number of lines.
2. The twice-seen filters, folded so that all of them stay under ``FILTER_BYTES`` together, go to all tasks. Only
   lines that they suspect are shuffled, as full digests, to count their documents exactly and to find the document
   that keeps them. A fuller filter lets more lines through to that step and never loses one.
3. A document meets the numbers of its dropped lines by its id and the digest of its text.

Rows of one doc_id are one document, those without doc_id too, and that one comes before all others. Null and empty
texts are one empty line. All lines of a shared key stay in the document that keeps it, repeated ones too; repeated
rows lose the same lines. Texts of any length are looked at whole; an empty table gives no rows. Other columns pass as
they are, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.llm.common import Rows, rows_of, stored, table

LEAST_CHARS = 40
LEAST_DOCS = 5
STRIPPED = b" \t\n\x0b\x0c\r"
#: A segment's filters have 2^23 places for about 2^20 lines, four places a line; a false suspect has a chance of .03.
SEGMENT_LINES, PLACE_BITS, PROBES = 1 << 20, 23, 4
#: Bound of all twice-seen filters together, which every worker gets.
FILTER_BYTES = 1 << 26
#: Hashes that a task hands on at a time.
FLUSH_HASHES = 1 << 18
#: Tasks between which the documents of one line are dealt.
SALTS = 16


def line_keys(raw: bytes, least: int = LEAST_CHARS) -> Iterator[tuple[int, bytes]]:
    """Number and key of each line of at least so many code points; a key is stripped and has A-Z lower-cased."""
    for i, line in enumerate(raw.split(b"\n")):
        if len(line) >= least:
            key = line.strip(STRIPPED).lower()
            if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode(errors="replace")) >= least):
                yield i, key


def _places(hashes):
    """Places of each hash within its segment, one row for each probe."""
    import numpy as np

    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(11)) | np.uint64(1)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    return np.stack([((low + np.uint64(i) * high) & mask).astype(np.int64) for i in range(PROBES)])


def _segment(hashes, bits: int):
    import numpy as np

    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """n, hashes (sorted, unsigned 64 bits each): the keys of long lines, each once for a row of docs."""
    schema = pa.schema([("n", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        held: list[int] = []

        def flushed() -> pa.RecordBatch:
            out = np.sort(np.array(held, np.uint64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(out)], pa.int64()), pa.array([out.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for (raw,) in rows_of(batch):
                held.extend(map(xxhash.xxh3_64_intdigest, {key for _, key in line_keys(raw or b"", least)}))
                while len(held) >= FLUSH_HASHES:
                    yield flushed()
        if held:
            yield flushed()

    return docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "n long, hashes binary")


class Suspects:
    """The folded twice-seen filters of all segments."""

    def __init__(self, bits: int, folded_bits: int, segments: dict[int, bytes]):
        import numpy as np

        size = 1 << folded_bits
        self.bits, self.folded_bits = bits, folded_bits
        self.image = np.zeros((1 << bits) * size // 8, np.uint8)
        for number, image in segments.items():
            self.image[number * size // 8 : (number + 1) * size // 8] = np.frombuffer(image, np.uint8)

    def has(self, hashes):
        """Which of the hashes may have been seen twice."""
        import numpy as np

        at = _places(hashes) & ((1 << self.folded_bits) - 1)
        at += _segment(hashes, self.bits) << self.folded_bits
        return ((self.image[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def twice_seen(hashes: DataFrame, filter_bytes: int = FILTER_BYTES) -> Suspects:
    """Filters of the hashes that occur twice. At most ``filter_bytes`` reach the driver, however many lines there are."""
    total = hashes.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total - 1) // SEGMENT_LINES).bit_length()
    folded = max(3, min(PLACE_BITS, (filter_bytes * 8).bit_length() - 1 - bits))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        out = Rows(pa.schema([("segment", pa.int64()), ("hashes", pa.binary())]))
        for batch in batches:
            for (raw,) in rows_of(batch):
                held = np.frombuffer(raw, np.uint64)
                numbers = _segment(held, bits)
                starts = np.flatnonzero(np.diff(numbers, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(held)], strict=True):
                    out.add((int(numbers[a]), held[a:b].tobytes()), 8 * int(b - a))
                    if out.full():
                        yield out.take()
        yield out.take()

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in rows_of(batch):
                if number not in once:
                    once[number], twice[number] = np.zeros(1 << PLACE_BITS, bool), np.zeros(1 << folded, bool)
                held, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                at = _places(held)
                again = (n > 1) | once[number][at].all(axis=0)
                twice[number][at[:, again] & ((1 << folded) - 1)] = True
                once[number][at] = True
        out = Rows(pa.schema([("segment", pa.int64()), ("filter", pa.binary())]))
        for number, places in twice.items():
            image = np.packbits(places, bitorder="little").tobytes()
            out.add((number, image), len(image))
            if out.full():
                yield out.take()
        yield out.take()

    dealt = hashes.select("hashes").mapInArrow(cut, "segment long, hashes binary").repartition(1 << bits, "segment")
    filters = dealt.mapInArrow(fill, "segment long, filter binary").collect()
    return Suspects(bits, folded, {r["segment"]: bytes(r["filter"]) for r in filters})


def suspected_lines(docs: DataFrame, suspects: Suspects, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_id, key (SHA-256 of a line's key), lines (its numbers in the text) of lines that the filters suspect."""
    shared = docs.sparkSession.sparkContext.broadcast(suspects)  # bounded by FILTER_BYTES
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", kind).add("text_id", "binary").add("key", "binary").add("lines", T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        known, digest = shared.value, xxhash.xxh3_64_intdigest
        for batch in batches:
            out = Rows(pa.schema([batch.schema.field(0), ("text_id", pa.binary()), ("key", pa.binary()), ("lines", pa.list_(pa.int32()))]))
            for doc_id, text_id, raw in rows_of(batch):
                places: dict[bytes, list[int]] = {}
                for i, key in line_keys(raw or b"", least):
                    places.setdefault(key, []).append(i)
                if not places:
                    continue
                found = known.has(np.fromiter(map(digest, places), np.uint64, len(places)))
                for (key, lines), seen in zip(places.items(), found.tolist(), strict=True):
                    if seen:
                        out.add((doc_id, text_id, hashlib.sha256(key).digest(), lines), 64)
                if out.full():
                    yield out.take()
            yield out.take()

    return docs.select("doc_id", "text_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, schema)


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_id, drops (numbers of lines to drop) for texts that lose any; docs: doc_id, text_id, text."""
    suspects = twice_seen(stored(line_hashes(docs, least_chars), "line-hashes"))
    lines = stored(suspected_lines(docs, suspects, least_chars), "suspects")
    # counts of documents are combined before each shuffle, so a line of all documents makes one row a task
    holders = lines.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    shared = holders.filter(F.col("n") >= least_docs)
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("text_id", "doc_id"), F.lit(SALTS)).cast("int")
    dropped = lines.withColumn("salt", salt).join(salted, ["key", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return dropped.groupBy("doc_id", "text_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drops"))


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """row (all columns of docs as they were), text (without the dropped lines), n_lines (before), n_dropped."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    known = whole.select("row", F.col("row.doc_id").alias("doc_id"), F.unhex(F.md5(F.col("row.text").cast("binary"))).alias("text_id"))
    drops = dropped_lines(known.select("doc_id", "text_id", F.col("row.text").alias("text")), least_chars, least_docs)
    drops = drops.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), "drops")
    # a hot id or text meets one row of drops, so its rows can be split where the join is skewed
    met = known.join(drops, known["doc_id"].eqNullSafe(drops["d"]) & (known["text_id"] == drops["t"]), "left")
    schema = T.StructType().add("row", docs.schema).add("text", "string").add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in rows_of(batch.select([1, 2])):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                n_dropped.append(len(drops or ()))
                if drops:
                    gone = set(drops)
                    text = "\n".join([line for i, line in enumerate(lines) if i not in gone])
                texts.append(text)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_lines", "n_dropped"])

    return met.select("row", F.col("row.text").alias("text"), "drops").mapInArrow(run, schema)


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows and columns of docs, ``text`` without the lines that at least so many documents share."""
    kept = kept_lines(docs, least_chars, least_docs)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op13_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
with lines as (
    select doc_id, unnest(generate_series(1, len(parts))) as i, unnest(parts) as line
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d
), keyed as (
    select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
    select k.doc_id, i, line, keeper is not null and keeper <> k.doc_id as gone from keyed k left join shared s on s.key = k.key
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
