"""Streams cut into triggers in different ways give the same answers; their state stays bounded and can be read."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from landq.operators import audit, merkle
from landq.streaming import admission, chains, content_index, jobs

DDL = "client string, request_id long, ts timestamp"


def stream_of(spark, folder, parts, ddl, per_trigger=1):
    """A stream over files in this order, so many a trigger."""
    for i, rows in enumerate(parts):
        before = set(folder.glob("*.parquet"))
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - before:
            os.utime(f, (1_000_000 + 100 * i, 1_000_000 + 100 * i))
    return spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


# ---------------------------------------------------------------- admission


def requests():
    """(client, id, second): bursts, pauses, ties, one busy client."""
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), i, rng.randrange(0, 4000)) for i in range(300)]
    return rows + [("a", 900 + i, 2000) for i in range(5)] + [("z", 950, 10), ("z", 951, 3999)]


def plain(rows, limit, seconds):
    out, windows = {}, {}
    for client, request_id, at in sorted(rows, key=lambda r: (r[2], r[1])):
        window = [t for t in windows.get(client, []) if t > at - seconds]
        out[client, request_id] = len(window) < limit
        windows[client] = window + [at] * (len(window) < limit)
    return out


def timed(spark, rows):
    return [(c, i, __import__("datetime").datetime.fromtimestamp(1_700_000_000 + at)) for c, i, at in rows]


def answers(spark, folder, parts, per_trigger=1, delay="10 minutes"):
    jobs.use_rocksdb(spark)
    stream = stream_of(spark, folder, [timed(spark, p) for p in parts], DDL, per_trigger)
    given, state = jobs.run_with_state(admission.admit(stream, 3, 60, delay), "admission")
    rest = admission.still_waiting(spark, state, 3, 60)
    return {(r.client, r.request_id): r.accepted for r in given.collect()}, {(r.client, r.request_id): r.accepted for r in rest.collect()}, state


def test_answers_do_not_depend_on_triggers(spark, tmp_path):
    rows = requests()
    want = plain(rows, 3, 60)
    assert 0 < sum(want.values()) < len(want)
    one, rest, _ = answers(spark, tmp_path / "one", [rows])
    assert one | rest == want and not one.keys() & rest.keys()
    # in order, cut into triggers
    ordered = sorted(rows, key=lambda r: r[2])
    cut = [ordered[i : i + 40] for i in range(0, len(ordered), 40)]
    many, rest, state = answers(spark, tmp_path / "many", cut)
    assert many | rest == want and not many.keys() & rest.keys()
    # what waits is no older than the delay, whatever came before
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(state)
    assert waiting.count() == len(rest) < len(rows) / 3


def test_late_rows_within_the_delay(spark, tmp_path):
    rows = requests()
    want = plain(rows, 3, 60)
    rng = random.Random(9)
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 500))  # up to 500 s late, the delay is 600
    cut = [shuffled[i : i + 50] for i in range(0, len(shuffled), 50)]
    got, rest, _ = answers(spark, tmp_path / "late", cut)
    assert got | rest == want


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    # the watermark follows a trigger later: 3 still comes in time to be judged with 1, 5 does not
    parts = [[("a", 1, 0)], [("a", 2, 5000)], [("a", 3, 10)], [("a", 4, 6000)], [("a", 5, 10)], [("a", 6, 6001)]]
    got, rest, _ = answers(spark, tmp_path / "behind", parts, delay="1 minute")
    assert (got | rest).keys() == {("a", i) for i in (1, 2, 3, 4, 6)}


# ---------------------------------------------------------------- audit


ENTRY_DDL = "who string, id long, action string, ts timestamp"
HASHED = ["id", "action"]


def entries(n=53):
    base = __import__("datetime").datetime(2024, 1, 1)
    delta = __import__("datetime").timedelta
    names = ["é\"q\\", "b"]
    return [(names[i % 7 == 3], i, [None, "VIEW", 'a"b\\ü\n', ""][i % 4], base + delta(seconds=i)) for i in range(n)]


def written_by_stream(spark, folder, parts, lanes=1):
    jobs.use_rocksdb(spark)
    stream = stream_of(spark, folder, parts, ENTRY_DDL)
    rows = chains.audit_entries(stream, "who", "id", "ts", HASHED, lanes)
    return jobs.run_with_state(chains.append_audit(rows, HASHED, 4), "audit")


@pytest.mark.parametrize("size", [53, 5])
def test_stream_and_batch_write_the_same_log(spark, tmp_path, size):
    rows = entries()
    log, state = written_by_stream(spark, tmp_path / "log", [rows[i : i + size] for i in range(0, len(rows), size)])
    batch = audit.append_chain(spark.createDataFrame(rows, ENTRY_DDL), "who", ["ts", "id"], [F.col("id")], HASHED, 4)
    columns = ["seq", "segment", "previous_hash", "current_hash"]
    want = sorted((r.who, r.id, *(r[c] for c in columns)) for r in batch.collect())
    assert sorted((r.chain_id, r.entry_id, *(r[c] for c in columns)) for r in log.collect()) == want
    verified = audit.verify_chain(log, "chain_id", HASHED, 4)
    assert verified.filter("broken is not null").count() == 0
    edited = log.withColumn("action", F.when(F.col("entry_id") == 9, "EDIT").otherwise(F.col("action")))
    assert [r.broken for r in audit.verify_chain(edited, "chain_id", HASHED, 4).filter("broken is not null").collect()] == ["content"]
    # the state knows the heads, and the same root that a tree over the segments has
    heads = audit.segment_heads(batch, "who")
    leaves = heads.select(F.col("chain_id").alias("tree"), F.col("segment").alias("pos"), audit.head_leaf().alias("digest"))
    roots = {r.tree: r.root for r in merkle.roots(merkle.tree_nodes(leaves)).collect()}
    held = {r.chain_id: r for r in chains.stored_heads(spark, state, 4).collect()}
    assert {c: r.root for c, r in held.items()} == roots
    sizes = {r.who: r["count"] for r in batch.groupBy("who").count().collect()}
    assert {c: r.entries for c, r in held.items()} == sizes


def test_lanes_verify(spark, tmp_path):
    log, state = written_by_stream(spark, tmp_path / "lanes", [entries()[:30], entries()[30:]], lanes=3)
    assert log.select("chain_id").distinct().count() == 6
    assert audit.verify_chain(log, "chain_id", HASHED, 4).filter("broken is not null").count() == 0
    assert chains.stored_heads(spark, state, 4).agg(F.sum("entries")).first()[0] == 53


def test_columns_of_the_log_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 2)], "who string, id long, seq long").withColumn("ts", F.current_timestamp())
    with pytest.raises(ValueError, match="seq"):
        chains.audit_entries(df, "who", "id", "ts", ["seq"])


@pytest.mark.parametrize("n", range(1, 18))
def test_peaks(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    peaks = []
    for i, leaf in enumerate(leaves):
        peaks = chains.with_peak(peaks, i, leaf)
    assert len(peaks) == bin(n).count("1")
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(f"node:{level[i]}{level[i + 1]}".encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    root = spark.createDataFrame([(peaks,)], "p array<string>").select(chains._root(F.col("p"))).first()[0]
    assert root == level[0]


# ---------------------------------------------------------------- ingest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text is not None else None


def test_ingest_over_many_triggers(spark, tmp_path):
    rng = random.Random(5)
    parts = [[(100 * i + j, f"text {rng.randrange(60)}") for j in range(12)] for i in range(9)]
    parts[3] += [(1, None), (2, None), (3, "")]
    parts[7] += [(4, None), (5, "")]
    stream = stream_of(spark, tmp_path / "in", parts, "id long, text string")
    held = spark.createDataFrame([(sha(f"text {i}"),) for i in range(0, 60, 3)], "sha256 string")
    path = str(tmp_path / "out")
    content_index.ingest_new(stream, "text", path, held, compact=2).awaitTermination()
    got = content_index.ingested(spark, path).collect()
    known = {f"text {i}" for i in range(0, 60, 3)}
    want = {t for part in parts for _, t in part} - known
    assert sorted(map(str, (r.sha256 for r in got))) == sorted(map(str, map(sha, want)))
    assert all(r.sha256 == sha(r.text) for r in got)
    # old generations of the index are gone
    kept = sorted(p.name for p in (tmp_path / "out" / "index").iterdir())
    assert kept == ["generation=6", "generation=8"]
    # the next run goes on from there
    more = stream_of(spark, tmp_path / "in", [[], [], [], [], [], [], [], [], [], [(900, "text 1"), (901, "entirely new")]], "id long, text string")
    content_index.ingest_new(more, "text", path, held, compact=2).awaitTermination()
    assert sorted(map(str, (r.sha256 for r in content_index.ingested(spark, path).collect()))) == sorted(map(str, map(sha, want | {"entirely new", "text 1"} - known)))


def test_a_trigger_that_runs_again_replaces_itself(spark, tmp_path):
    index = content_index.ContentIndex(spark, str(tmp_path), compact=2)
    index.start(None)
    uploads = lambda *texts: spark.createDataFrame([(t, sha(t)) for t in texts], "text string, sha256 string")
    for batch, texts in enumerate([("a", "b"), ("b", "c"), ("a", "d"), ("e", "c")]):
        index.merge(uploads(*texts), batch)
        index.merge(uploads(*texts), batch)
    got = {r.text: r.batch for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3}
    assert index.before(3).count() == 4


def test_only_buckets_of_the_uploads_are_read(spark, tmp_path):
    index = content_index.ContentIndex(spark, str(tmp_path), bucket_bits=4)
    index.start(spark.createDataFrame([(sha(str(i)),) for i in range(400)], "sha256 string"))
    files = lambda df: len(df.inputFiles())
    plan = index.before(0, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < index.before(0, [3]).count() < 60 and files(index.before(0)) == 16
    assert {r.bucket for r in index.before(0, [3, 7]).collect()} == {3, 7}


def test_state_is_worked_on_by_rows(spark, tmp_path):
    """A frame for each key costs more than the key's work (t4_lanes, t3_answered)."""
    stream = stream_of(spark, tmp_path / "rows", [entries(5)], ENTRY_DDL)
    log = chains.append_audit(chains.audit_entries(stream, "who", "id", "ts", HASHED), HASHED, 4)
    timed = stream.selectExpr("who client", "id request_id", "ts")
    for out in (log, admission.admit(timed, 3, 60, "1 minute")):
        work = out._jdf.queryExecution().logical().functionExpr()
        assert work.evalType() == PythonEvalType.SQL_TRANSFORM_WITH_STATE_PYTHON_ROW_UDF
