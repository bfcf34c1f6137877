import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from pyarrow import fs

from landq.llm.sharding import op10_sharding, ring, shard_rows, walk
from landq.llm.warc import op9_warc, page_of, parse, read, record, record_name, seek_table, write
from landq.session import shared_path

SF = "/root/testdata/sf0.001"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(40)]
    return rows + [(50, None, None), (51, "u", ""), (None, "u", "<p>0</p>"), (None, "u", "only null"), (52, "u", "é" * 300_000), (52, "u", "é" * 300_000), (-5, "a\nb", "\r\n\r\n")]


def test_archive_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    root = shared_path(spark, "test-warc")
    index = write(frame, root)
    got = read(index, root).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        refers = first.get(h or "")
        refers = None if refers == i else refers
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.payload for r in got if r.record_type == "response" and r.page_id == 52} == {"é" * 300_000}
    assert write(frame.limit(0), shared_path(spark, "test-warc")).count() == 0


def test_bundles_are_plain_zstandard(spark):
    root = shared_path(spark, "test-warc")
    index = write(spark.read.parquet(f"{SF}/pages.parquet"), root).collect()
    system, path = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
    for name in {r.bundle for r in index}:
        with system.open_input_file(f"{path}/{name}") as file:
            table = seek_table(file)
            file.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True).read()
        assert len(whole) == sum(plain for _, _, plain in table)
        starts = [sum(p for _, _, p in table[:i]) for i in range(len(table))]
        for r in index:
            if r.bundle == name:
                at = starts[r.frame] + r.offset
                got = parse(whole[at : at + r["size"]])
                assert page_of(got["fields"]["warc-record-id"]) == r.page_id


@pytest.mark.parametrize("page", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_names(page):
    assert page_of(record_name(page)) == page


def test_revisits_have_no_body():
    got = parse(record(1, "u", b"abc", "D", (7,)))
    assert got["payload"] is None and got["payload_bytes"] == 3 and page_of(got["fields"]["warc-refers-to"]) == 7
    assert parse(record(1, "u", b"\r\n\r\nabc", "D", None))["payload"] == b"\r\n\r\nabc"


def test_archive_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in op9_warc(spark, SF).collect()}
    assert got == {r.page_id: (len(r.html.encode()), "response") for r in rows} or len({r.html for r in rows}) < len(rows)


def placed_naively(positions, shards, nodes, bounds):
    """Keys of each shard when every key is put one by one."""
    points = ring(shards, nodes)
    room = list(bounds)
    order = sorted(range(len(positions)), key=lambda i: positions[i])
    at = {i: next((n for n, (p, _) in enumerate(points) if p >= positions[i]), 0) for i in order}
    owner, waiting = {}, []
    for i in order:
        shard = points[at[i]][1]
        if room[shard]:
            room[shard] -= 1
            owner[i] = shard
        else:
            waiting.append(i)
    # keys behind the last node belong to its first arc but wait as the last
    for i in waiting:
        n = at[i]
        while not room[points[n][1]]:
            n = (n + 1) % len(points)
        owner[i] = points[n][1]
        room[points[n][1]] -= 1
    return owner


def test_walk_equals_one_by_one():
    import bisect
    import random

    rng = random.Random(6)
    shards, nodes = 5, 3
    points = ring(shards, nodes)
    for n in (0, 1, 4, 50, 333):
        positions = sorted(rng.randrange(-(2**63), 2**63) for _ in range(n))
        loads = [0] * (len(points) + 1)
        for p in positions:
            loads[bisect.bisect_left([q for q, _ in points], p)] += 1
        bounds = [n // shards + (s < n % shards) for s in range(shards)]
        runs = walk(loads, [*(s for _, s in points), points[0][1]], bounds)
        owner = {i: s for a, b, s, _ in runs for i in range(a, b)}
        assert owner == placed_naively(positions, shards, nodes, bounds)
        slots = defaultdict(list)
        for a, b, s, base in runs:
            slots[s] += range(base, base + b - a)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert sorted(Counter(owner.values()).values()) == sorted(b for b in bounds if b)


def shards_are_right(rows, docs, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    facts = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == facts
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_shards(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    shards_are_right(shard_rows(odd_docs, 4, 8).collect(), docs, 4)
    assert shard_rows(no_docs).count() == 0
    one = spark.createDataFrame([(7, "x")] * 500, "doc_id long, text string").repartition(4)  # a key with all rows
    shards_are_right(shard_rows(one, 6, 4).collect(), [(7, "x")] * 500, 6)


def test_limited_movement(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    before = {r.doc_id: r.shard for r in shard_rows(docs, 10, 128).collect()}
    after = {r.doc_id: r.shard for r in shard_rows(docs, 11, 128).collect()}
    moved = sum(before[i] != after[i] for i in before) / 4000
    assert moved < 0.35  # a modulus would move nine tenths


def test_shard_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    shards_are_right(op10_sharding(spark, SF).collect(), docs, 24)
