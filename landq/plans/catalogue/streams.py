"""Queries that run as streams over what the directory holds, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import audit
from landq.operators.rules import RECORD_RULES
from landq.plans.catalogue import archive_views, legal, workflow
from landq.plans.catalogue.registry import CATALOGUE, query
from landq.plans.fixtures import VIEWS
from landq.session import shared_path
from landq.sources.readers import read_table
from landq.streaming import admission, chains, content_index, jobs
from landq.streaming.sources import event_time, stream_table


@query("t1_stream_ingest", sql="select distinct sha256(text) sha256 from documents", streaming=True)
def ingest(spark, sf):
    return taken_in(spark, sf)


def taken_in(spark, sf, history=None):
    path = shared_path(spark, "ingest")
    docs = stream_table(spark, sf, "documents").select("doc_id", "text")
    content_index.ingest_new(docs, "text", path, history).awaitTermination()
    return content_index.ingested(spark, path).select("sha256")


@query("t1_stream_checks", sql=CATALOGUE["v9_identifier_format"].sql, streaming=True)
def checks(spark, sf):
    arriving = spark.sql(VIEWS["fx_records"], orders=stream_table(spark, sf, "orders"))
    return jobs.run_to_table(jobs.identifier_checks(arriving), "checks")


@query(
    "t1_stream_history",
    sql="select distinct sha256(text) sha256 from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)",
    streaming=True,
)
def news(spark, sf):
    """Uploads whose content is not in the archive yet: the even documents are its history."""
    held = read_table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return taken_in(spark, sf, held)


ALONE = "', '".join(RECORD_RULES)


@query(
    "t1_stream_rules",
    legal.INPUTS,
    f"select document_id, rule_id, status from ({legal.RESULTS}) t where rule_id in ('{ALONE}')",
    streaming=True,
)
def rule_checks(spark, sf):
    arriving = spark.sql(VIEWS["fx_records"], orders=stream_table(spark, sf, "orders"))
    return jobs.run_to_table(jobs.record_checks(arriving, legal.BOOK), "rules").select("document_id", "rule_id", "status")


@query(
    "t2_activity_counts",
    sql="""select cast(ts as date) "day", event_type, count(*) n from events
        where cast(ts as date) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by 1, 2""",
    streaming=True,
)
def activity(spark, sf):
    events = event_time(stream_table(spark, sf, "events"))
    out = jobs.run_to_table(jobs.activity_counts(events, "ts", "event_type"), "activity")
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n")


LIMIT, SECONDS = 2, 43_200
ADMITTED = f"""with recursive e as (select cast(user_id as varchar) client, event_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) n from events),
      w as (select client, event_id, n, [us] kept, true accepted from e where n = 1
        union all select e.client, e.event_id, e.n,
          case when len(list_filter(w.kept, lambda t: t > e.us - {SECONDS * 1_000_000})) < {LIMIT} then list_append(list_filter(w.kept, lambda t: t > e.us - {SECONDS * 1_000_000}), e.us)
            else list_filter(w.kept, lambda t: t > e.us - {SECONDS * 1_000_000}) end,
          len(list_filter(w.kept, lambda t: t > e.us - {SECONDS * 1_000_000})) < {LIMIT}
        from w join e on e.client = w.client and e.n = w.n + 1)
    select client, event_id request_id, accepted from w"""


def requests(spark, sf):
    events = event_time(stream_table(spark, sf, "events"))
    return events.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("request_id"), "ts")


@query("t3_admission_control", sql=ADMITTED, streaming=True)
def admitted(spark, sf):
    """Answers of the stream, and those to what still waits for the watermark when it stops."""
    jobs.use_rocksdb(spark)
    given, state = jobs.run_with_state(admission.admit(requests(spark, sf), LIMIT, SECONDS, "1 day"), "admission")
    return given.unionAll(admission.still_waiting(spark, state, LIMIT, SECONDS)).drop("us")


@query(
    "t3_answered",
    sql=f"""select * from ({ADMITTED}) a where request_id in (
          select event_id from events where ts <= (select date_trunc('millisecond', max(ts)) from events) - interval 1 day)""",
    streaming=True,
)
def answered(spark, sf):
    """What the stream itself has answered: requests that the watermark has passed."""
    jobs.use_rocksdb(spark)
    return jobs.run_to_table(admission.admit(requests(spark, sf), LIMIT, SECONDS, "1 day"), "answered").drop("us")


LANES = 4


def stream_log(spark, sf, lanes=1):
    """The audit log as a stream writes it, and the folder of the stream's state."""
    jobs.use_rocksdb(spark)
    events = event_time(stream_table(spark, sf, "events")).select(
        "user_id",
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "ts",
        F.unix_micros("ts").alias("us"),
    )
    entries = chains.audit_entries(events, "user_id", "event_id", "ts", workflow.HASHED, lanes)
    return jobs.run_with_state(chains.append_audit(entries, workflow.HASHED, workflow.SEGMENT), "audit")


@query(
    "t4_audit_stream",
    sql=f"with {workflow.CHAIN} select cast(user_id as varchar) chain_id, event_id entry_id, seq, segment, previous_hash, current_hash from c",
    streaming=True,
)
def audit_stream(spark, sf):
    """The same hashes as the batch operator's."""
    return stream_log(spark, sf)[0].select("chain_id", "entry_id", "seq", "segment", "previous_hash", "current_hash")


@query("t4_verified", sql=f"select cast(user_id as varchar) chain_id, seq, null::varchar broken from ({workflow.NUMBERED}) y", streaming=True)
def stream_verified(spark, sf):
    """The stream's log under the batch operator's verification."""
    return audit.verify_chain(stream_log(spark, sf)[0], "chain_id", workflow.HASHED, workflow.SEGMENT).drop("current_hash")


@query(
    "t4_lanes",
    sql=f"""select concat(user_id, '/', event_id % {LANES}) chain_id, count(*) total_blocks, true chain_valid, null::bigint broken_at, null::varchar break_kind
        from ({workflow.ENTRIES}) x group by 1""",
    streaming=True,
)
def stream_lanes(spark, sf):
    """Every chain written as four parallel ones, verified against the heads that the stream's state holds."""
    log, state = stream_log(spark, sf, LANES)
    held = chains.stored_heads(spark, state, workflow.SEGMENT)
    last = F.floor((F.col("entries") - 1) / workflow.SEGMENT)
    heads = held.select("chain_id", last.alias("segment"), "last_hash", (F.col("entries") - last * workflow.SEGMENT).alias("entries"))
    verified = audit.verify_chain(log, "chain_id", workflow.HASHED, workflow.SEGMENT)
    return audit.chain_summary(verified, "chain_id", audit.sealed_breaks(log, heads, "chain_id", workflow.SEGMENT)).drop("latest_hash")


@query(
    "t4_state_heads",
    sql=f"""with {workflow.CHAIN}, leaves as (select user_id, segment pos, count(*) over (partition by user_id) n,
          sha256('leaf:' || cast(to_json([cast(user_id as varchar), cast(segment as varchar), cast(count(*) as varchar), arg_max(current_hash, seq)]) as varchar)) digest
          from c group by user_id, segment),
        nodes as (select user_id, pos, n, digest from leaves
          union all select a.user_id, a.pos // 2, (a.n + 1) // 2, case when b.digest is null then a.digest else sha256('node:' || a.digest || b.digest) end
            from nodes a left join nodes b on b.user_id = a.user_id and b.pos = a.pos + 1 where a.pos % 2 = 0 and a.n > 1)
        select cast(c.user_id as varchar) chain_id, count(*) entries, arg_max(current_hash, seq) last_hash, any_value(digest) root
        from c join nodes on nodes.user_id = c.user_id and n = 1 group by c.user_id""",
    streaming=True,
)
def state_heads(spark, sf):
    """Heads of the chains and roots over their segments, out of the stream's state alone."""
    return chains.stored_heads(spark, stream_log(spark, sf)[1], workflow.SEGMENT)


@query("t5_stream_fanout", sql=CATALOGUE["s16_signed_outbox"].sql, streaming=True)
def fan_out(spark, sf):
    events = event_time(stream_table(spark, sf, "events"))
    path = shared_path(spark, "outbox")
    jobs.fan_out(events, archive_views.subscriptions(spark), f"{path}/table", f"{path}/state").awaitTermination()
    out = spark.read.parquet(f"{path}/table")
    return out.select("event_id", "subscription_id", "payload", "signature")


