"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends with a seek table in a skippable frame, as
in Zstandard's seekable format, and the index maps each record to its bundle, frame and offset within the frame, so
that a reader fetches one frame for one record. Payloads seen before are ``revisit`` records without a body.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import Rows, rows_of, stored, table, task_number
from landq.session import shared_path

FRAME_BYTES = 512 << 10
BUNDLE_BYTES = 256 << 20
#: Fixed values of the formats: skippable frame of the seek table, its closing number, the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
INDEX_DDL = "page_id long, bundle string, frame int, offset long, size long"
INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])
READ_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def record_name(page_id: int | None) -> str:
    """Record id of a page; a null page_id has the nil id."""
    return f"<{uuid.UUID(int=0 if page_id is None else (1 << 64) + (page_id & (1 << 64) - 1)).urn}>"


def page_of(name: str) -> int | None:
    number = uuid.UUID(name.strip("<>")).int
    low = number & (1 << 64) - 1
    return None if not number else low - (1 << 64) if low >> 63 else low


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; ``refers_to`` is the (page_id,) that holds the payload, or None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_name(refers_to[0])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: headers by lower-case name, the payload (None in a revisit), and the payload's size."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return {"fields": fields, "payload": None if fields["warc-type"] == "revisit" else payload, "payload_bytes": size}


class Bundle:
    """Writes one bundle: frames of records, then the seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level)
        self.frames, self.open, self.filled, self.written = [], [], 0, 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset within the frame) of the record."""
        if self.filled and self.filled + len(raw) > FRAME_BYTES:
            self.cut()
        place = (len(self.frames), self.filled)
        self.open.append(raw)
        self.filled += len(raw)
        return place

    def cut(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.stream.write(packed)
            self.frames.append((len(packed), self.filled))
            self.written += len(packed)
            self.open, self.filled = [], 0

    def close(self) -> None:
        self.cut()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of every frame, read from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, closing = struct.unpack("<IBI", file.read(9))
    if closing != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    at, table = 0, []
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        table.append((at, packed, plain))
        at += packed
    return table


def opened(uri: str):
    """(file system, path) of a location in the shared folder, as every task can reach it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first (smallest page_id with that payload; nulls count as largest).

    The digests are found in a first pass and joined back, so html is dealt once, by page.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"))
    # a payload that very many pages share is one row here after partial aggregation; only repeated ones are joined
    firsts = rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, "sha", "left")


def write(pages: DataFrame, root: str) -> DataFrame:
    """Write all pages under ``root`` and return the index: page_id, bundle, frame, offset, size.

    Null html is an empty payload, a null url an empty target; a null page_id becomes the nil record id and never the
    original of others unless all pages with that payload have it. Of repeated rows with the smallest page_id each is
    a response. A task writes under a name of its own attempt; only bundles in the committed index exist for readers,
    so lost executors and repeated tasks leave nothing double. An empty table gives an empty index.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(root)
        system.create_dir(path, recursive=True)
        out, bundle, name = Rows(INDEX), None, ""
        for batch in batches:
            for page_id, url, html, first in rows_of(batch):
                payload = (html or "").encode()
                refers = None if first is None or first == page_id else (first,)
                raw = record(page_id, url, payload, digest_of(payload), refers)
                if bundle and bundle.written > BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
                if not bundle:
                    name = f"{task_number():06d}-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{path}/{name}", compression=None))
                frame, offset = bundle.add(raw)
                out.add((page_id, name, frame, offset, len(raw)))
                if out.full():
                    yield out.take()
        if bundle:
            bundle.close()
        yield out.take()

    typed = with_types(pages).select("page_id", "url", "html", "first")
    return stored(typed.mapInArrow(run, INDEX_DDL), "warc-index")


def read(index: DataFrame, root: str) -> DataFrame:
    """Records of the index, read back by frame. Frames are dealt to tasks; the rows of one frame stay together."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "size")).alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, path = opened(root)
        schema = pa.schema(
            [
                ("page_id", pa.int64()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("record_type", pa.string()),
                ("refers_to", pa.int64()),
                ("url", pa.string()),
                ("payload", pa.string()),
            ]
        )
        out, tables = Rows(schema), {}
        for batch in batches:
            for name, frame, places in rows_of(batch):
                with system.open_input_file(f"{path}/{name}") as file:
                    if name not in tables:
                        tables = {name: seek_table(file)}
                    at, packed, plain = tables[name][frame]
                    file.seek(at)
                    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
                for place in places:
                    got = parse(data[place["offset"] : place["offset"] + place["size"]])
                    fields, payload = got["fields"], got["payload"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (len(payload) != got["payload_bytes"] or digest_of(payload) != digest):
                        raise ValueError(f"damaged record {fields['warc-record-id']} in {name}")
                    refers = fields.get("warc-refers-to")
                    out.add(
                        (
                            page_of(fields["warc-record-id"]),
                            got["payload_bytes"],
                            digest,
                            fields["warc-type"],
                            page_of(refers) if refers else None,
                            fields["warc-target-uri"],
                            None if payload is None else payload.decode(),
                        ),
                        len(payload or b""),
                    )
                    if out.full():
                        yield out.take()
        yield out.take()

    return frames.mapInArrow(run, READ_DDL)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), root)
    return read(index, root).drop("url", "payload")


OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as digest from pages),
f as (select digest, min(page_id) as first_id from p group by digest),
bits as (
    select p.page_id, octet_length(body) as n, first_id, array_to_string(list_transform(string_split(p.digest, ''), lambda h:
        ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111']
        [strpos('0123456789abcdef', h)]), '') as b
    from p join f using (digest)
)
select page_id, n::bigint as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
        + 16 * substr(b, 5 * i + 1, 1)::int + 8 * substr(b, 5 * i + 2, 1)::int + 4 * substr(b, 5 * i + 3, 1)::int
        + 2 * substr(b, 5 * i + 4, 1)::int + substr(b, 5 * i + 5, 1)::int, 1)), '') as payload_digest,
    case when first_id is null or page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from first_id then first_id end as refers_to
from bits
"""
