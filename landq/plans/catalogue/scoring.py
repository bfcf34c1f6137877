"""Queries over confidence, routing, calibration and the field tables behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import calibration, confidence, evaluate, review
from landq.operators import records as rec
from landq.plans.catalogue import legal
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.fixtures import fx
from landq.sources import rulebook as rb
from landq.sources.dictionaries import inline_table
from landq.sources.readers import read_table


def fields(spark, sf):
    df = fx(spark, sf, "fx_fields")
    return df.withColumn("bbox", F.array("y0", "x0", "y1", "x1")).withColumn("flags", F.array().cast("array<string>"))


TILES = [(0.0, 0.0, 0.5, 0.5), (0.0, 0.5, 0.5, 1.0), (0.5, 0.0, 1.0, 0.5), (0.5, 0.5, 1.0, 1.0)]


def pages(spark, sf):
    """Pages with a 2 x 2 tile grid; the measures of the tiles differ by position."""
    tiles = F.array(
        *[
            F.struct(
                F.array(*[F.lit(v) for v in box]).alias("bbox"),
                (F.col("blur") + 10.0 * i).alias("blur"),
                "fade",
                "stain",
                (F.col("tear") * float(i)).alias("tear"),
            )
            for i, box in enumerate(TILES)
        ]
    )
    quality = F.struct(
        "blur_score",
        "fade_score",
        "stain_coverage",
        F.when(~F.col("no_tiles"), tiles).alias("tile_metrics"),
    )
    return fx(spark, sf, "fx_pages").select("page_id", "document_id", quality.alias("quality"))


@query(
    "p3_widen",
    ["fx_fields"],
    """select document_id, max(case when field_name = 'owner_0_name' then value end) owner_0_name,
         max(case when field_name = 'survey_no' then value end) survey_no, max(case when field_name = 'village' then value end) village
       from fx_fields where field_name in ('owner_0_name', 'survey_no', 'village') group by document_id""",
)
def widen(spark, sf):
    return rec.widen(fx(spark, sf, "fx_fields"), ["owner_0_name", "survey_no", "village"])


@query(
    "p4_first_filled",
    ["fx_records"],
    "select document_id, coalesce(nullif(na_order_ref, ''), nullif(tenure_perm_ref, ''), nullif(reg_no, '')) reference from fx_records",
)
def first_filled(spark, sf):
    from landq.functions.text import first_filled as pick

    return fx(spark, sf, "fx_records").select(
        "document_id",
        pick(F.col("na_order_ref"), F.col("tenure_perm_ref"), F.col("reg_no")).alias("reference"),
    )


@query(
    "p2_effective_values",
    ["fx_fields"],
    f"""select document_id, field_name, line_id, case when line_id % 2 = 0 and line_id % 3 <> 0 then raw_text else value end "value",
         {q.rounded("confidence", 4)} confidence from fx_fields""",
)
def effective(spark, sf):
    reviewed = fields(spark, sf).withColumns(
        {
            "is_reviewed": F.col("line_id") % 2 == 0,
            "reviewed_value": F.when(F.col("line_id") % 3 != 0, F.col("raw_text")),
        }
    )
    return rec.effective_values(reviewed).select("document_id", "field_name", "line_id", "value", "confidence")


def _tile(i: int) -> str:
    blur, tear = f"(p.blur + 10.0 * {i})", f"(p.tear * cast({i} as double))"
    d = lambda v: f"cast({v} as double)"
    return (
        f"(case when {blur} < 120 then {d(0.15)} * (1 - least({blur} / {d(120)}, {d(1)})) else 0 end"
        f" + case when p.fade > {d(0.35)} then {d(0.15)} * p.fade else 0 end"
        f" + case when p.stain > {d(0.10)} then {d(0.12)} * p.stain else 0 end"
        f" + case when {tear} > {d(0.05)} then {d(0.25)} * {tear} else 0 end)"
    )


def _touch(i: int) -> str:
    y0, x0, y1, x1 = TILES[i]
    return f"(f.x1 >= cast({x0} as double) and f.x0 <= cast({x1} as double) and f.y1 >= cast({y0} as double) and f.y0 <= cast({y1} as double))"


_COUNT = " + ".join(f"cast({_touch(i)} as int)" for i in range(4))
_SUM = " + ".join(f"case when {_touch(i)} then {_tile(i)} else cast(0 as double) end" for i in range(4))
_PAGE = """(case when p.blur_score < 100 then cast(0.12 as double) * (1 - least(p.blur_score / cast(100 as double), cast(1 as double))) else 0 end
    + case when p.fade_score > cast(0.4 as double) then cast(0.12 as double) * p.fade_score else 0 end
    + case when p.stain_coverage > cast(0.15 as double) then cast(0.10 as double) * p.stain_coverage else 0 end)"""
DAMAGE = f"""case when p.page_id is null then cast(0 as double) else least(cast(0.35 as double),
    {q.rounded(f"(case when p.no_tiles then {_PAGE} else coalesce(({_SUM}) / nullif({_COUNT}, 0), 0) end)", 4)}) end"""


@query(
    "p15_damage_penalty",
    ["fx_fields", "fx_pages"],
    f"select f.document_id, f.field_name, f.line_id, {DAMAGE} penalty from fx_fields f left join fx_pages p on f.page_id = p.page_id",
)
def damage(spark, sf):
    rated = pages(spark, sf).select("page_id", confidence.rated_quality(F.col("quality")).alias("rated"))
    joined = fields(spark, sf).join(rated, "page_id", "left")
    return joined.select(
        "document_id", "field_name", "line_id", confidence.damage_penalty(F.col("bbox"), F.col("rated")).alias("penalty")
    )


def _format(name: str, value: str) -> str:
    t, n = f"trim({value})", q.number(f"trim({value})")
    fit = lambda p, low: f"case when regexp_matches({t}, '{p}') then cast(1 as double) else cast({low} as double) end"
    return f"""case when coalesce({t}, '') = '' then cast(0 as double)
      when contains({name}, 'ulpin') then {fit("^[A-Z0-9]{14}$", 0.3)}
      when contains({name}, 'date') then {fit("^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})$", 0.4)}
      when contains({name}, 'survey') or contains({name}, 'khasra') then {fit("^[0-9]+([/-][0-9A-Za-z]+)?$", 0.6)}
      when contains({name}, 'share') then {fit("^([0-9]+/[0-9]+|[0-9]+(\\.[0-9]+)?%?)$", 0.4)}
      when contains({name}, 'area') and not contains({name}, 'unit') then case when {n} > 0 then cast(1 as double) when {n} is not null then cast(0.2 as double) else cast(0.3 as double) end
      else cast(1 as double) end"""


FORMAT = _format("f.field_name", "f.value")


@query("p16_format_score", ["fx_fields"], f"select f.document_id, f.field_name, f.line_id, {FORMAT} score from fx_fields f")
def format_score(spark, sf):
    return fields(spark, sf).select(
        "document_id", "field_name", "line_id", confidence.format_score(F.col("field_name"), F.col("value")).alias("score")
    )


FLAGS = f"select document_id, {', '.join(f'''bool_or(rule_id = '{r}') f{i}''' for i, r in enumerate(confidence.CONSISTENCY))} from ({legal.RESULTS}) z where status = 'failed' group by document_id"
CONSISTENT = (
    "least(cast(1 as double), "
    + ", ".join(
        f"case when coalesce(w.f{i}, false) and ({' or '.join(f'''contains(f.field_name, '{k}')''' for k in words)}) then cast({s} as double) else cast(1 as double) end"
        for i, (words, s) in enumerate(confidence.CONSISTENCY.values())
    )
    + ")"
)
ALL = ["fx_records", "fx_owners", "fx_mutations", "fx_fields", "fx_pages"]


@query(
    "p17_consistency",
    ALL,
    f"select f.document_id, f.field_name, f.line_id, {CONSISTENT} consistency from fx_fields f left join ({FLAGS}) w on f.document_id = w.document_id",
)
def consistency(spark, sf):
    flags = confidence.failed_rule_flags(legal.all_results(spark, sf))
    joined = fields(spark, sf).join(flags, "document_id", "left")
    known = {r: F.coalesce(F.col(r), F.lit(False)) for r in confidence.CONSISTENCY}
    return joined.select(
        "document_id", "field_name", "line_id", confidence.consistency_score(F.col("field_name"), known).alias("consistency")
    )


AGREE = "greatest(cast(0 as double), least(cast(1 as double), f.agreement))"
FINAL = f"""(cast(0.4 as double) * case when f.confidence > 0 then least(cast(1 as double), f.confidence) else cast(0.8 as double) end
    + cast(0.2 as double) * {AGREE} + cast(0.2 as double) * {FORMAT} + cast(0.2 as double) * {CONSISTENT} - {DAMAGE})"""
SCORED = f"""select f.document_id, f.field_name, f.line_id, {q.rounded(f"greatest(cast(0.05 as double), least(cast(0.99 as double), {FINAL}))", 3)} confidence,
      cast({DAMAGE} > cast(0.08 as double) as int) + cast({AGREE} < cast(0.8 as double) as int) + cast({FORMAT} < cast(0.7 as double) as int) + cast({CONSISTENT} < cast(0.7 as double) as int) notes
    from fx_fields f left join fx_pages p on f.page_id = p.page_id left join ({FLAGS}) w on f.document_id = w.document_id"""


def scored(spark, sf):
    return confidence.score_fields(fields(spark, sf), pages(spark, sf), legal.all_results(spark, sf))


@query("p18_field_confidence", ALL, f"select document_id, field_name, line_id, confidence, cast(notes as int) notes from ({SCORED}) s")
def field_confidence(spark, sf):
    return scored(spark, sf).select(
        "document_id", "field_name", "line_id", "confidence", F.size("flags").alias("notes")
    )


MEAN = q.rounded("(cast(sum(cast(confidence as decimal(18,6))) as double) / count(*))", 3)


@query("a5_overall_confidence", ALL, f"select document_id, {MEAN} overall_confidence from ({SCORED}) s group by document_id")
def overall(spark, sf):
    return confidence.overall_confidence(scored(spark, sf))


# routing from the stored confidences, so that all three routes occur
PLAIN = "select document_id, field_name, 0.55 + confidence * 0.45 confidence from fx_fields"
CRITICAL = "(contains(field_name, 'owner') or contains(field_name, 'survey') or contains(field_name, 'khasra') or contains(field_name, 'area') or contains(field_name, 'share'))"
LOWS = f"{CRITICAL} and confidence < cast(0.6 as double)"
CRITICAL_DOCS = "select document_id from fx_records where reg_no <> '' and reg_no in (select reg_no from fx_records group by reg_no having count(*) > 1)"
ROUTED = f"""select d.document_id, d.overall_confidence,
      case when c.document_id is not null or low or d.overall_confidence < cast(0.6 as double) then 'document_review' when any_low then 'field_review' else 'auto_accepted' end status,
      case when c.document_id is not null or low or d.overall_confidence < cast(0.6 as double) then 'high' when any_low then 'medium' else 'low' end priority, flagged_fields
    from (select document_id, {MEAN} overall_confidence, bool_or({LOWS}) low, bool_or(not ({LOWS}) and confidence < cast(0.9 as double)) any_low,
            count(case when confidence < cast(0.9 as double) then 1 end) flagged_fields from ({PLAIN}) x group by document_id) d
    left join (select distinct document_id from ({CRITICAL_DOCS}) y) c on c.document_id = d.document_id"""


def plain(spark, sf):
    return fields(spark, sf).withColumn("confidence", F.lit(0.55) + F.col("confidence") * 0.45)


def critical(spark, sf):
    from landq.operators import rules

    return confidence.critical_documents(rules.duplicate_registry(fx(spark, sf, "fx_records"), legal.BOOK))


@query("p19_routing", ["fx_fields", "fx_records"], ROUTED)
def routing(spark, sf):
    f = plain(spark, sf)
    return confidence.route(f, confidence.overall_confidence(f), critical(spark, sf))


REASONS = f"""select document_id, field_name, case when {LOWS} then 'critical_field' else 'field' end kind from ({PLAIN}) x where confidence < cast(0.9 as double)
    union all select distinct document_id, cast(null as varchar(20)), 'rule' from ({CRITICAL_DOCS}) y"""


@query("p19_routing_reasons", ["fx_fields", "fx_records"], REASONS)
def reasons(spark, sf):
    return confidence.routing_reasons(plain(spark, sf), critical(spark, sf)).select("document_id", "field_name", "kind")


@query(
    "r1_create_tasks",
    ["fx_fields", "fx_records"],
    f"""select r.document_id, r.priority, coalesce(n, 0) reasons, 1 - r.overall_confidence uncertainty from ({ROUTED}) r
        left join (select document_id, count(*) n from ({REASONS}) q group by document_id) k on r.document_id = k.document_id
        where r.status in ('field_review', 'document_review')""",
)
def create_tasks(spark, sf):
    f, crit = plain(spark, sf), critical(spark, sf)
    routed = confidence.route(f, confidence.overall_confidence(f), crit)
    tasks = review.create_tasks(routed, confidence.routing_reasons(f, crit), F.current_timestamp())
    return tasks.select("document_id", "priority", "reasons", "uncertainty")


@query(
    "p25_bare_flagged",
    ["fx_fields"],
    "select document_id, field_name, line_id from fx_fields where confidence < cast(0.9 as double) or line_id % 7 = 0",
)
def bare(spark, sf):
    noted = fields(spark, sf).withColumn(
        "flags", F.when(F.col("line_id") % 7 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    )
    return confidence.bare_flagged(noted).select("document_id", "field_name", "line_id")


# labels: document quality against a score from its length
SCORE_SQL = "select cast(10000 * d.n_chars // (d.n_chars + 2500) as double) / 10000 confidence, cast(l.quality as double) label from labels l join documents d on l.doc_id = d.doc_id"


def labelled(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = read_table(spark, sf, "labels").join(docs, "doc_id")
    return joined.select(
        (F.expr("10000 * n_chars div (n_chars + 2500)").cast("double") / 10000).alias("confidence"),
        F.col("quality").cast("double").alias("label"),
    )


def _ece(bins: int) -> str:
    return f"""select cast(sum(abs(c - l)) as double) / cast(sum(n) as double) ece, cast(sum(n) as bigint) samples from (
        select least({bins - 1}, floor(confidence * {bins})) b, count(*) n, sum(cast(confidence as decimal(28,10))) c, sum(cast(label as decimal(28,10))) l from ({SCORE_SQL}) s group by 1) t"""


@query("a6_ece_8_bins", sql=_ece(8))
def ece8(spark, sf):
    return calibration.ece(labelled(spark, sf), 8)


@query("a7_ece_10_bins", sql=_ece(10))
def ece10(spark, sf):
    return calibration.ece(labelled(spark, sf), 10)


@query(
    "a7_auto_accept_precision",
    sql=f"""select count(*) samples, count(case when confidence >= cast(0.9 as double) then 1 end) accepted,
        coalesce(cast(sum(case when confidence >= cast(0.9 as double) then cast(label as decimal(28,10)) end) as double) / nullif(count(case when confidence >= cast(0.9 as double) then 1 end), 0), 1) "precision",
        count(case when confidence >= cast(0.9 as double) then 1 end) * cast(100 as double) / count(*) automation_pct from ({SCORE_SQL}) s""",
)
def accept(spark, sf):
    return calibration.auto_accept(labelled(spark, sf), 0.9)


# isotonic value of the k-th distinct score: over starts up to k the largest of the smallest weighted means that end at k or later
CALIBRATED = f"""s as ({SCORE_SQL}), g as (select confidence, count(*) w, sum(label) t, row_number() over (order by confidence) k from s group by confidence),
        c as (select k, confidence, sum(w) over (order by k) w, sum(t) over (order by k) t from g),
        m as (select a.k i, b.k j, (b.t - (a.t - x.t)) / cast(b.w - (a.w - x.w) as double) mean from c a join g x using (k) join c b on a.k <= b.k),
        l as (select i, j, min(mean) over (partition by i order by j rows between current row and unbounded following) least from m),
        v as (select j k, greatest(0.05, least(0.99, round(max(least), 12))) calibrated from l group by j),
        fitted as (select s.confidence, s.label, cast(v.calibrated as double) calibrated from s join g on s.confidence = g.confidence join v on v.k = g.k)"""


def _fitted_ece(column: str) -> str:
    return f"""(select cast(sum(abs(c - l)) as double) / cast(sum(n) as double) from (select least(7, floor({column} * 8)) b, count(*) n,
        sum(cast({column} as decimal(28,10))) c, sum(cast(label as decimal(28,10))) l from fitted group by 1) t)"""


@query(
    "a8_isotonic_calibration",
    sql=f"""with {CALIBRATED}, e as (select {_fitted_ece("confidence")} pre, {_fitted_ece("calibrated")} post, count(*) samples,
            count(*) filter (calibrated >= cast(0.9 as double)) accepted, sum(label) filter (calibrated >= cast(0.9 as double)) good from fitted)
        select samples, {q.rounded("pre", 4)} ece_pre, {q.rounded("post", 4)} ece_post,
            {q.rounded("((pre - post) / greatest(cast(1e-5 as double), pre) * cast(100 as double))", 1)} reduction_pct,
            {q.rounded("coalesce(good / nullif(accepted, 0), cast(1 as double))", 4)} auto_accept_precision,
            {q.rounded("(accepted * cast(100 as double) / samples)", 1)} automation_pct from e""",
)
def isotonic(spark, sf):
    return calibration.calibration_report(labelled(spark, sf))


LOGISTIC = f"""recursive s as ({SCORE_SQL}), pts as (select confidence x, cast(count(*) as double) n, sum(label) t from s group by confidence),
        it as (select 0 k, cast(0 as double) a, cast(0 as double) b
          union all select k + 1, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01), b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) from (
            select k, a, b, sum(t - n * p) - a g0, sum((t - n * p) * x) - b g1, sum(n * p * (1 - p)) + 1 h00, sum(n * p * (1 - p) * x) h01, sum(n * p * (1 - p) * x * x) + 1 h11
            from (select k, a, b, x, n, t, cast(1 as double) / (exp(-(a + b * x)) + 1) p from it, pts where k < {calibration.NEWTON_STEPS}) u group by k, a, b) z),
        curve as (select a, b from it where k = {calibration.NEWTON_STEPS}),
        fitted as (select s.confidence, s.label, greatest(cast(0.05 as double), least(cast(0.99 as double), round(cast(1 as double) / (exp(-(a + b * s.confidence)) + 1), 9))) calibrated from s, curve)"""


@query("a8_logistic_curve", sql=f"with {LOGISTIC} select round(a, 6) intercept, round(b, 6) slope from curve")
def logistic_curve(spark, sf):
    a, b = calibration.fit_logistic(labelled(spark, sf))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


@query(
    "a8_logistic_calibration",
    sql=f"""with {LOGISTIC}, e as (select {_fitted_ece("confidence")} pre, {_fitted_ece("calibrated")} post, count(*) samples,
            count(*) filter (calibrated >= cast(0.9 as double)) accepted, sum(label) filter (calibrated >= cast(0.9 as double)) good from fitted)
        select samples, {q.rounded("pre", 4)} ece_pre, {q.rounded("post", 4)} ece_post,
            {q.rounded("((pre - post) / greatest(cast(1e-5 as double), pre) * cast(100 as double))", 1)} reduction_pct,
            {q.rounded("coalesce(good / nullif(accepted, 0), cast(1 as double))", 4)} auto_accept_precision,
            {q.rounded("(accepted * cast(100 as double) / samples)", 1)} automation_pct from e""",
)
def logistic(spark, sf):
    return calibration.calibration_report(labelled(spark, sf), fit=calibration.calibrate_logistic)


@query(
    "a9_fault_recall",
    ALL,
    f"""with f as (select document_id, case document_id % 3 when 0 then 'reused_registration' when 1 then 'backdated_mutation' else 'share_mismatch' end fault from fx_records),
        d as (select * from {q.rows(["fault", "rule_id"], [("reused_registration", rb.DUPLICATE), ("backdated_mutation", rb.CHRONOLOGY), ("share_mismatch", rb.SHARES)])}),
        x as (select distinct document_id, rule_id from ({legal.RESULTS}) r where status = 'failed')
        select f.fault, count(*) n, count(x.document_id) * cast(100 as double) / count(*) recall_pct
        from f join d on d.fault = f.fault left join x on x.document_id = f.document_id and x.rule_id = d.rule_id group by f.fault""",
)
def fault_recall(spark, sf):
    kind = F.col("document_id") % 3
    faults = fx(spark, sf, "fx_records").select(
        "document_id",
        F.when(kind == 0, "reused_registration").when(kind == 1, "backdated_mutation").otherwise("share_mismatch").alias("fault"),
    )
    detects = inline_table(
        spark,
        ["fault", "rule_id"],
        [("reused_registration", rb.DUPLICATE), ("backdated_mutation", rb.CHRONOLOGY), ("share_mismatch", rb.SHARES)],
    )
    return evaluate.fault_recall(faults, legal.all_results(spark, sf), detects)


@query(
    "j13_merge_pages",
    ["fx_owners"],
    """with p as (select document_id, name, pos, cast(parcel_id % 3 + 1 as int) page_no, share from fx_owners),
         l as (select *, row_number() over (partition by document_id, name order by page_no, pos, share) rn from p a where page_no > 1 and name <> ''
               and not exists (select 1 from p b where b.document_id = a.document_id and b.name = a.name and b.page_no = 1))
       select document_id, name, pos, page_no, share from p where page_no = 1
       union all select document_id, name, pos, page_no, share from l where rn = 1""",
)
def merge_pages(spark, sf):
    rows = fx(spark, sf, "fx_owners").select(
        "document_id", "name", "pos", (F.col("parcel_id") % 3 + 1).cast("int").alias("page_no"), "share"
    )
    return rec.merge_pages(rows, "name")
