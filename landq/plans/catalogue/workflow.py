"""Queries over review, corrections, audit chains and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.functions.hashing import GENESIS
from landq.operators import audit, merkle, ordered, ownership, review
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.catalogue.scoring import fields
from landq.plans.fixtures import fx
from landq.sources.dictionaries import ROLE_ALIASES, ROLE_PERMISSIONS
from landq.sources.readers import read_table

# ---------------------------------------------------------------- review


@query(
    "k1_review_queue",
    ["fx_tasks"],
    "select task_id, uncertainty from fx_tasks where status in ('needs_review', 'maker_reviewed', 'pending') order by uncertainty desc, created_at desc, task_id limit 50",
)
def queue(spark, sf):
    return review.queue(fx(spark, sf, "fx_tasks"), 50).select("task_id", "uncertainty")


@query(
    "k1_filtered_queue",
    ["fx_tasks"],
    "select task_id, uncertainty from fx_tasks where status = 'verified' and priority = 'high' order by uncertainty desc, created_at desc, task_id limit 25",
)
def filtered_queue(spark, sf):
    return review.queue(fx(spark, sf, "fx_tasks"), 25, status="verified", priority="high").select("task_id", "uncertainty")


@query(
    "j4_queue_documents",
    ["fx_tasks", "fx_records"],
    """select t.task_id, coalesce(r.filename, 'Unknown') filename, coalesce(r.doc_type, 'unknown') doc_type from fx_tasks t
       left join fx_records r on r.document_id = t.document_id""",
)
def queue_documents(spark, sf):
    out = review.queue_with_documents(fx(spark, sf, "fx_tasks"), fx(spark, sf, "fx_records"))
    return out.select("task_id", "filename", "doc_type")


LATEST = """select document_id, field_name, arg_max(new_value, (ts, event_id)) new_value, arg_max(reviewer_id, (ts, event_id)) reviewer_id from fx_overrides group by document_id, field_name"""


@query(
    "r2_overrides",
    ["fx_fields", "fx_overrides"],
    f"""select f.document_id, f.field_name, f.line_id, o.document_id is not null is_reviewed, o.new_value reviewed_value, o.reviewer_id reviewed_by,
          case when o.document_id is not null then cast(1 as double) else f.confidence end confidence
        from fx_fields f left join ({LATEST}) o on o.document_id = f.document_id and o.field_name = f.field_name""",
)
def overrides(spark, sf):
    out = review.apply_overrides(fields(spark, sf), fx(spark, sf, "fx_overrides"))
    return out.select("document_id", "field_name", "line_id", "is_reviewed", "reviewed_value", "reviewed_by", "confidence")


CORRECTIONS = """select o.event_id, f.document_id, f.field_name, f.raw_text, f.value model_value, o.new_value corrected_value, o.reviewer_id, o.ts created_at
      from fx_overrides o join fx_fields f on o.document_id = f.document_id and o.field_name = f.field_name"""


def corrections(spark, sf):
    return review.correction_log(fx(spark, sf, "fx_overrides"), fields(spark, sf))


@query(
    "r3_correction_log",
    ["fx_overrides", "fx_fields"],
    f"select event_id, document_id, field_name, raw_text, model_value, corrected_value, reviewer_id from ({CORRECTIONS}) c",
)
def correction_log(spark, sf):
    return corrections(spark, sf).drop("created_at")


ALIASES = f"select field_name, raw_text, arg_max(corrected_value, (created_at, event_id)) preferred_value, count(*) usage_count from ({CORRECTIONS}) c where raw_text <> '' group by field_name, raw_text"


@query("a11_alias_memory", ["fx_overrides", "fx_fields"], ALIASES)
def aliases(spark, sf):
    return review.alias_memory(corrections(spark, sf)).drop("updated_at")


@query(
    "j11_apply_aliases",
    ["fx_overrides", "fx_fields"],
    f"""select f.document_id, f.field_name, f.line_id, coalesce(a.preferred_value, f.value) suggested_value
        from fx_fields f left join ({ALIASES}) a on a.field_name = f.field_name and a.raw_text = f.raw_text""",
)
def apply_aliases(spark, sf):
    memory = review.alias_memory(corrections(spark, sf))
    return review.apply_aliases(fields(spark, sf), memory).select("document_id", "field_name", "line_id", "suggested_value")


ROLE = "case lower(role) " + " ".join(f"when '{a}' then '{r}'" for a, r in ROLE_ALIASES.items()) + " else lower(role) end"


def _holders(permission: str) -> str:
    return "('" + "', '".join(r for r, p in ROLE_PERMISSIONS.items() if permission in p) + "')"


MAKES, CHECKS = f"{ROLE} in {_holders('REVIEW_TASK_MAKER')}", f"{ROLE} in {_holders('REVIEW_TASK_CHECKER')}"
STAGED = f"""select *, coalesce(is_checker, {ROLE} in ('supervisor', 'admin')) stage,
      ({MAKES} or {CHECKS}) and not (coalesce(is_checker, false) and not ({CHECKS})) allowed from fx_review"""


@query("r5_review_rights", ["fx_review"], f"select event_id, stage is_checker_stage, allowed from ({STAGED}) s")
def rights(spark, sf):
    return review.with_stage(fx(spark, sf, "fx_review")).select("event_id", "is_checker_stage", "allowed")


@query("r5_quarantine", ["fx_review"], f"select event_id, role from ({STAGED}) s where not allowed")
def quarantine(spark, sf):
    return review.split_allowed(fx(spark, sf, "fx_review"))[1].select("event_id", "role")


@query(
    "r4_review_state",
    ["fx_review", "fx_tasks"],
    f"""with e as (select * from ({STAGED}) s where allowed),
        l as (select task_id, arg_max(action, (ts, event_id)) act, arg_max(stage, (ts, event_id)) checked, count(*) n,
                arg_max(reviewer_id, (ts, event_id)) filter (not stage) maker_id, arg_max(reviewer_id, (ts, event_id)) filter (stage) checker_id from e group by task_id)
        select t.task_id, case when l.task_id is null then 'needs_review' when t.double_review_required and not checked then 'maker_reviewed'
            when checked and act = 'approved' then 'verified' else act end status,
          case when l.task_id is null then 'needs_review' when t.double_review_required and not checked then 'maker_reviewed' when act = 'approved' then 'published' else 'rejected' end document_status,
          maker_id, checker_id, coalesce(maker_id = checker_id, false) same_person, coalesce(n, 0) events,
          case when l.task_id is not null and not (t.double_review_required and not checked) then greatest(cast(0.99 as double), 1 - uncertainty) else 1 - uncertainty end overall_confidence
        from fx_tasks t left join l on l.task_id = t.task_id""",
)
def state(spark, sf):
    accepted, _ = review.split_allowed(fx(spark, sf, "fx_review"))
    out = review.review_state(fx(spark, sf, "fx_tasks"), accepted)
    return out.select(
        "task_id", "status", "document_status", "maker_id", "checker_id", "same_person", "events", "overall_confidence"
    )


@query(
    "s13_correction_messages",
    ["fx_overrides", "fx_fields"],
    f"""select event_id, cast(to_json(struct_pack(messages := [
          struct_pack(role := 'system', content := 'Extract standardized land record field.'),
          struct_pack(role := 'user', content := concat('Extract field ''', field_name, ''' from raw text: ''', coalesce(raw_text, ''), '''')),
          struct_pack(role := 'assistant', content := corrected_value)])) as varchar) line from ({CORRECTIONS}) c""",
)
def messages(spark, sf):
    return review.correction_messages(corrections(spark, sf)).select("event_id", "line")


# ---------------------------------------------------------------- audit

SEGMENT = 20
ENTRIES = "select user_id, event_id, event_type, cast(round(value * 100) as bigint) cents, ts, epoch_us(ts) us from events"
HASHED = ["event_id", "event_type", "cents", "us"]


def entries(spark, sf):
    return read_table(spark, sf, "events").select(
        "user_id",
        "event_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def chained(spark, sf):
    splits = [F.floor(F.col("us") / 86_400_000_000)]
    return audit.append_chain(entries(spark, sf), "user_id", ["us", "event_id"], splits, HASHED, SEGMENT)


CELLS = ", ".join(f"cast({c} as varchar)" for c in ["user_id", "seq", *HASHED])


def chain_sql(rows: str) -> str:
    """The hash chain ``c`` over entries, as steps of a recursive statement."""
    return f"""recursive e as (select *, cast(to_json([{CELLS}]) as varchar) body, cast(floor(seq / {SEGMENT}) as bigint) segment
        from (select *, row_number() over (partition by user_id order by us, event_id) - 1 seq from ({rows}) x) y),
      s as (select *, case when segment = 0 then '{GENESIS}' else sha256(concat(user_id, ':', segment)) end seed from e),
      c as (select user_id, event_id, us, seq, segment, seed previous_hash, sha256(seed || body) current_hash from s where seq % {SEGMENT} = 0
        union all select s.user_id, s.event_id, s.us, s.seq, s.segment, c.current_hash, sha256(c.current_hash || s.body)
          from c join s on s.user_id = c.user_id and s.seq = c.seq + 1 and s.seq % {SEGMENT} <> 0)"""


CHAIN = chain_sql(ENTRIES)


@query("w2_audit_append", sql=f"with {CHAIN} select user_id, event_id, seq, segment, previous_hash, current_hash from c")
def append(spark, sf):
    return chained(spark, sf).select("user_id", "event_id", "seq", "segment", "previous_hash", "current_hash")


EDITED = "event_type = 'error' and cents > 9000"


def tampered(spark, sf):
    """The log with some amounts changed after the fact."""
    edited = (F.col("event_type") == "error") & (F.col("cents") > 9000)
    return chained(spark, sf).withColumn("cents", F.when(edited, F.col("cents") + 1).otherwise(F.col("cents")))


BROKEN = f"""select user_id, row_number() over (partition by user_id order by us, event_id) - 1 seq, case when {EDITED} then 'content' end broken from ({ENTRIES}) x"""


@query("w1_audit_verify", sql=BROKEN)
def verify(spark, sf):
    return audit.verify_chain(tampered(spark, sf), "user_id", HASHED, SEGMENT).drop("current_hash")


NUMBERED = f"select *, row_number() over (partition by user_id order by us, event_id) - 1 seq from ({ENTRIES}) x"


@query(
    "w1_missing_segment",
    sql=f"select user_id, seq, case when seq = {2 * SEGMENT} then 'link' end broken from ({NUMBERED}) y where seq // {SEGMENT} <> 1",
)
def missing_segment(spark, sf):
    """The log without the second segment of every chain."""
    return audit.verify_chain(chained(spark, sf).filter("segment <> 1"), "user_id", HASHED, SEGMENT).drop("current_hash")


@query(
    "w1_link_break",
    sql=f"""select user_id, seq, case when seq % {SEGMENT} = 8 then 'link' end broken from ({NUMBERED}) y where seq % {SEGMENT} <> 7""",
)
def link_break(spark, sf):
    """The log without one entry of every segment."""
    return audit.verify_chain(chained(spark, sf).filter(f"seq % {SEGMENT} <> 7"), "user_id", HASHED, SEGMENT).drop("current_hash")


@query(
    "w1_swapped",
    sql=f"select user_id, case when seq in (4, 5) then 9 - seq else seq end seq, case when seq between 4 and 6 and n > 5 then 'link' end broken from (select *, count(*) over (partition by user_id) n from ({NUMBERED}) y) z where n > 6",
)
def swapped(spark, sf):
    """Two neighbouring entries of every chain change places."""
    rows = chained(spark, sf)
    long = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 6").select("user_id")
    moved = rows.join(long, "user_id").withColumn("seq", F.expr("case when seq in (4, 5) then 9 - seq else seq end"))
    return audit.verify_chain(moved, "user_id", HASHED, SEGMENT).drop("current_hash")


@query("w2_second_batch", sql=f"with {CHAIN} select user_id, event_id, seq, segment, previous_hash, current_hash from c")
def second_batch(spark, sf):
    """The log written in two parts, the second on the heads of the first."""
    rows, splits = entries(spark, sf), [F.floor(F.col("us") / 86_400_000_000)]
    early = F.col("us") < 1_705_000_000_000_000
    first = audit.append_chain(rows.filter(early), "user_id", ["us", "event_id"], splits, HASHED, SEGMENT)
    heads = audit.segment_heads(first, "user_id")
    second = audit.append_chain(rows.filter(~early), "user_id", ["us", "event_id"], splits, HASHED, SEGMENT, heads=heads)
    return first.unionByName(second).select("user_id", "event_id", "seq", "segment", "previous_hash", "current_hash")


@query(
    "a12_chain_summary",
    sql=f"""select user_id, count(*) total_blocks, count(broken) = 0 chain_valid, min(case when broken is not null then seq end) broken_at,
        arg_min(broken, case when broken is not null then seq end) break_kind from ({BROKEN}) b group by user_id""",
)
def summary(spark, sf):
    verified = audit.verify_chain(tampered(spark, sf), "user_id", HASHED, SEGMENT)
    return audit.chain_summary(verified, "user_id").drop("latest_hash")


@query(
    "w2_segment_heads",
    sql=f"with {CHAIN} select user_id chain_id, segment, arg_max(current_hash, seq) last_hash, count(*) entries from c group by user_id, segment",
)
def heads(spark, sf):
    return audit.segment_heads(chained(spark, sf), "user_id")


CUT = 3


def sizes(log):
    return log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def cut_off(log, which):
    """The log without the last entries of some chains."""
    kept = ~which | (F.col("seq") < F.col("n") - CUT)
    return log.join(sizes(log), "user_id").filter(kept).drop("n")


def rewritten(log, which):
    """The log after somebody changed the second segment of some chains and worked out all hashes anew."""
    forged = F.col("cents") + F.when(which & (F.col("segment") == 1), 1).otherwise(0)
    entered = log.select("user_id", "event_id", "event_type", forged.alias("cents"), "ts", "us")
    return audit.append_chain(entered, "user_id", ["us", "event_id"], [F.floor(F.col("us") / 86_400_000_000)], HASHED, SEGMENT)


COUNTED = f"select user_id, seq, seq // {SEGMENT} segment, count(*) over (partition by user_id) n from ({NUMBERED}) y"


@query(
    "w1_cut_tail",
    sql=f"""select user_id chain_id, greatest(n - {CUT}, segment * {SEGMENT}) seq, 'missing' broken from (select distinct user_id, segment, n from ({COUNTED}) k) t
        where user_id % 2 = 0 and least(n, (segment + 1) * {SEGMENT}) > n - {CUT}""",
)
def cut_tail(spark, sf):
    """Chains that end too early, which only the heads can tell."""
    log = chained(spark, sf)
    kept = cut_off(log, F.col("user_id") % 2 == 0)
    return audit.sealed_breaks(kept, audit.segment_heads(log, "user_id"), "user_id", SEGMENT)


@query(
    "w1_removed_chain",
    sql=f"select distinct user_id chain_id, segment * {SEGMENT} seq, 'missing' broken from ({COUNTED}) k where user_id % 7 = 0",
)
def removed_chain(spark, sf):
    log = chained(spark, sf)
    return audit.sealed_breaks(log.filter("user_id % 7 <> 0"), audit.segment_heads(log, "user_id"), "user_id", SEGMENT)


@query(
    "w1_rewritten_segment",
    sql=f"select distinct user_id chain_id, {SEGMENT}::bigint seq, 'rewritten' broken from ({COUNTED}) k where user_id % 3 = 0 and n > {SEGMENT}",
)
def rewritten_segment(spark, sf):
    """Every link of these logs fits; the heads differ."""
    log = chained(spark, sf)
    return audit.sealed_breaks(rewritten(log, F.col("user_id") % 3 == 0), audit.segment_heads(log, "user_id"), "user_id", SEGMENT)


FORGED = f"select user_id, event_id, event_type, cents + case when user_id % 4 = 3 and seq // {SEGMENT} = 1 then 1 else 0 end cents, ts, us from ({NUMBERED}) f"


@query(
    "a12_with_heads",
    sql=f"""with {chain_sql(FORGED)}, z as (select *, count(*) over (partition by user_id) n from c),
        k as (select *, not (user_id % 4 = 2 or user_id % 4 = 1 and seq >= n - {CUT}) kept from z)
        select user_id, count(*) filter (kept) total_blocks, user_id % 4 = 0 or user_id % 4 = 3 and n <= {SEGMENT} chain_valid,
          case when user_id % 4 = 1 then greatest(n - {CUT}, 0) when user_id % 4 = 2 then 0 when user_id % 4 = 3 and n > {SEGMENT} then {SEGMENT} end broken_at,
          case when user_id % 4 in (1, 2) then 'missing' when user_id % 4 = 3 and n > {SEGMENT} then 'rewritten' end break_kind,
          arg_max(current_hash, seq) filter (kept) latest_hash from k group by user_id, n""",
)
def summary_with_heads(spark, sf):
    """A log with intact chains, cut tails, removed chains and rewritten segments, judged with the heads of the true one."""
    log = chained(spark, sf)
    kind = F.col("user_id") % 4
    now = cut_off(rewritten(log, kind == 3), kind == 1).filter(kind != 2)
    verified = audit.verify_chain(now, "user_id", HASHED, SEGMENT)
    return audit.chain_summary(verified, "user_id", audit.sealed_breaks(now, audit.segment_heads(log, "user_id"), "user_id", SEGMENT))


WEEK = 7 * 86_400_000_000
SEALED = f"""{CHAIN}, heads as (select us // {WEEK} batch, user_id chain_id, segment, arg_max(current_hash, seq) last_hash, max(seq) - segment * {SEGMENT} + 1 entries
        from c group by 1, 2, 3),
      leaves as (select *, row_number() over (partition by batch order by sha256(cast(chain_id as varchar)), chain_id, segment) - 1 pos,
        count(*) over (partition by batch) n, sha256('leaf:' || cast(to_json([cast(chain_id as varchar), cast(segment as varchar), cast(entries as varchar), last_hash]) as varchar)) digest
        from heads),
      nodes as (select batch, 0 as level, pos, n, digest from leaves
        union all select a.batch, a.level + 1, a.pos // 2, (a.n + 1) // 2, case when b.digest is null then a.digest else sha256('node:' || a.digest || b.digest) end
          from nodes a left join nodes b on b.batch = a.batch and b.pos = a.pos + 1 where a.pos % 2 = 0 and a.n > 1)"""


def weekly_heads(spark, sf):
    log = chained(spark, sf).withColumn("batch", F.floor(F.col("us") / WEEK))
    return audit.batch_heads(log, "user_id", "batch", SEGMENT)


@query(
    "w1_batch_seals",
    sql=f"""with {SEALED}, r as (select batch, digest root, row_number() over (order by batch) - 1 seq from nodes where n = 1),
        b as (select r.*, (select count(*) from leaves l where l.batch = r.batch) heads from r),
        p as (select *, cast(to_json(['seals', cast(seq as varchar), cast(batch as varchar), cast(heads as varchar), root]) as varchar) body from b),
        x as (select batch, heads, root, seq, '{GENESIS}' previous_hash, sha256('{GENESIS}' || body) current_hash from p where seq = 0
          union all select p.batch, p.heads, p.root, p.seq, x.current_hash, sha256(x.current_hash || p.body) from x join p on p.seq = x.seq + 1)
        select * from x""",
)
def batch_seals(spark, sf):
    """One root for each week's writing, and the chain over the roots."""
    return audit.batch_seals(audit.sealed_tree(weekly_heads(spark, sf)))


@query(
    "w1_forged_heads",
    sql=f"with w as (select distinct us // {WEEK} batch from ({ENTRIES}) e) select batch, batch % 2 <> 0 valid from w",
)
def forged_heads(spark, sf):
    """Heads of which one was changed in every second batch, against the sealed roots."""
    heads = weekly_heads(spark, sf)
    seals = audit.batch_seals(audit.sealed_tree(heads))
    chosen = heads.groupBy("batch").agg(F.min(F.struct("chain_id", "segment")).alias("f"))
    one = (F.col("batch") % 2 == 0) & (F.struct("chain_id", "segment") == F.col("f"))
    presented = heads.join(chosen, "batch").withColumn("entries", F.col("entries") + one.cast("int")).drop("f")
    return audit.seal_breaks(presented, seals)


@query(
    "w1_head_proofs",
    sql=f"""with {SEALED}, walk as (select batch, chain_id, segment, 0 as level, pos, n, '' path, 0 as steps from leaves
          union all select w.batch, w.chain_id, w.segment, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.path || coalesce(s.digest, ''), w.steps + (s.digest is not null)::int
          from walk w left join nodes s on s.batch = w.batch and s.level = w.level and s.pos = xor(w.pos, 1) where w.n > 1)
        select batch, chain_id, segment, steps, sha256(path) path_hash, true verified from walk where n = 1""",
)
def head_proofs(spark, sf):
    """What shows each head to somebody who holds the week's root alone."""
    heads = weekly_heads(spark, sf)
    nodes = audit.sealed_tree(heads)
    found = audit.head_proofs(heads, nodes).join(audit.batch_seals(nodes).select("batch", "root"), "batch")
    path = F.sha2(F.concat_ws("", F.transform("proof", lambda p: p["sibling"])), 256)
    shown = merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")
    return found.select("batch", "chain_id", "segment", F.size("proof").alias("steps"), path.alias("path_hash"), shown.alias("verified"))


@query(
    "w7_sliding_requests",
    sql="select event_id, count(*) over (partition by user_id order by ts range between interval 86400 seconds preceding and current row) n from events",
)
def sliding(spark, sf):
    return ordered.trailing_count(read_table(spark, sf, "events"), "user_id", "ts", 86400).select("event_id", "n")


# ---------------------------------------------------------------- ownership

DAY = f"coalesce({q.date('mutation_date')}, date '1970-01-01')"
SENT = "coalesce(nullif(from_party, ''), 'Prior State/Ancestor')"
GOT = "coalesce(nullif(to_party, ''), 'Purchaser')"


@query(
    "w3_ownership_timeline",
    ["fx_mutations"],
    f"""select parcel_id, document_id, idx, mutation_no, row_number() over (partition by parcel_id order by {DAY}, document_id, idx, mutation_no) rn,
          concat(upper(left(mutation_type, 1)), substring(mutation_type, 2), ' transfer from ''', {SENT}, ''' to ''', {GOT}, '''') action from fx_mutations""",
)
def timeline(spark, sf):
    out = ownership.timeline(fx(spark, sf, "fx_mutations"))
    return out.select("parcel_id", "document_id", "idx", "mutation_no", "rn", "action")


@query(
    "w4_missing_roots",
    ["fx_mutations"],
    f"""select parcel_id, document_id from (select *, row_number() over (partition by parcel_id order by {DAY}, document_id, idx, mutation_no, coalesce(from_party, '')) rn from fx_mutations) t
        where rn = 1 and coalesce(from_party, '') = ''""",
)
def missing_roots(spark, sf):
    return ownership.missing_roots(fx(spark, sf, "fx_mutations")).select("parcel_id", "document_id")


@query(
    "w4_title_breaks",
    ["fx_mutations"],
    f"""select parcel_id, document_id, idx, from_party, last_holder from (
          select *, lag(to_party) over (partition by parcel_id order by {DAY}, document_id, idx, mutation_no) last_holder from fx_mutations) t
        where last_holder is not null and last_holder is distinct from from_party""",
)
def title_breaks(spark, sf):
    out = ownership.title_breaks(fx(spark, sf, "fx_mutations"))
    return out.select("parcel_id", "document_id", "idx", "from_party", "last_holder")


@query(
    "k4_party_nodes",
    ["fx_owners", "fx_mutations"],
    f"""select parcel_id, party, ['current_owner', 'prior_owner', 'intermediate_party'][min(o) + 1] "role" from (
          select parcel_id, name party, 0 o from fx_owners union all select parcel_id, {SENT}, 1 from fx_mutations union all select parcel_id, {GOT}, 2 from fx_mutations) t
        where party is not null group by parcel_id, party""",
)
def nodes(spark, sf):
    return ownership.party_nodes(fx(spark, sf, "fx_owners"), fx(spark, sf, "fx_mutations"))


@query(
    "k4_transfer_links",
    ["fx_mutations"],
    f"select parcel_id, {SENT} source, {GOT} target, mutation_no, coalesce(nullif(mutation_date, ''), 'Undated') mutation_date, mutation_type \"type\", transferred_area from fx_mutations",
)
def links(spark, sf):
    return ownership.transfer_links(fx(spark, sf, "fx_mutations"))
