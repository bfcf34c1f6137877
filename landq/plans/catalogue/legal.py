"""Queries over the legal-consistency rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import rules
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.fixtures import fx
from landq.sources import rulebook as rb
from landq.sources.dictionaries import ADMIN_DIRECTORY, LEGAL_DISCLAIMER
from landq.sources.rulebook import RuleBook

BOOK = RuleBook.default()
AS_OF = "2000-06-30"

DIRECTORY = q.rows(
    ["st", "di", "te", "vi"],
    [
        (s, d, t, v.lower())
        for s, ds in ADMIN_DIRECTORY.items()
        for d, ts in ds.items()
        for t, vs in ts.items()
        for v in vs
    ],
)

SHARES = f"""select document_id, cast(sum(cast({q.share("share")} as decimal(28,12))) as double) total_share, count(*) owner_count
    from fx_owners group by document_id"""


@query(
    "v1_share_sum",
    ["fx_owners"],
    f"select document_id, total_share, owner_count, case when abs(total_share - 1) > cast(0.01 as double) then 'failed' else 'passed' end status from ({SHARES}) t",
)
def share_sum(spark, sf):
    out = rules.share_sum(fx(spark, sf, "fx_owners"), BOOK)
    return out.select(
        "document_id",
        F.col("evidence")["total_share"].cast("double").alias("total_share"),
        F.col("evidence")["owners"].cast("long").alias("owner_count"),
        "status",
    )


@query(
    "v1_share_evidence",
    ["fx_owners"],
    f"select o.document_id, o.pos, o.share_raw from fx_owners o join ({SHARES}) t on o.document_id = t.document_id where abs(total_share - 1) > cast(0.01 as double)",
)
def share_evidence(spark, sf):
    owners = fx(spark, sf, "fx_owners")
    return rules.share_evidence(owners, rules.share_sum(owners, BOOK))


@query(
    "v2_area_holding",
    ["fx_records", "fx_mutations"],
    """select document_id, idx, transferred_area, holding_sqm from (
         select m.document_id, m.idx, m.transferred_area, r.holding_sqm,
           row_number() over (partition by m.document_id order by m.idx, m.transferred_area) rn
         from fx_mutations m join fx_records r on m.document_id = r.document_id
         where r.holding_sqm <> 0 and m.transferred_area > r.holding_sqm * cast(1.01 as double)) t where rn = 1""",
)
def area_holding(spark, sf):
    return rules.area_excess(fx(spark, sf, "fx_records"), fx(spark, sf, "fx_mutations"), BOOK)


DATED = f"""select m.document_id, m.idx, m.mutation_no, {q.date("m.mutation_date")} d,
      {q.date("coalesce(nullif(m.registration_date, ''), nullif(r.reg_date, ''))")} g
    from fx_mutations m left join fx_records r on m.document_id = r.document_id"""


@query(
    "v3_chronology",
    ["fx_records", "fx_mutations"],
    f"""select document_id, idx, 'Mutation to Come' rule_name from ({DATED}) t where d > date '{AS_OF}'
        union all select document_id, idx, 'Mutation before Deed' from ({DATED}) t where d < g""",
)
def chronology(spark, sf):
    out = rules.chronology(fx(spark, sf, "fx_records"), fx(spark, sf, "fx_mutations"), BOOK, AS_OF)
    return out.select("document_id", F.col("evidence")["mutation_index"].cast("int").alias("idx"), "rule_name")


@query(
    "v3c_numbering_gaps",
    ["fx_mutations"],
    f"""select document_id, idx, number, previous from (
          select document_id, idx, number, lag(number) over (partition by document_id order by d, number, idx) previous
          from (select document_id, idx, {q.date("mutation_date")} d, try_cast(regexp_extract(mutation_no, '([0-9]+)$', 1) as bigint) number
                from fx_mutations) a where d is not null and number is not null) b where number - previous <> 1""",
)
def numbering_gaps(spark, sf):
    return rules.numbering_gaps(fx(spark, sf, "fx_mutations")).select("document_id", "idx", "number", "previous")


@query(
    "v4_deceased_transferors",
    ["fx_owners", "fx_mutations"],
    """select o.document_id, o.party_name, m.mutation_no, m.idx from
         (select distinct document_id, name party_name from fx_owners where lower(is_deceased) in ('true', 'yes', 'मृत') and name <> '') o
         join fx_mutations m on o.document_id = m.document_id
         where m.from_party <> '' and contains(lower(m.from_party), lower(o.party_name))""",
)
def deceased(spark, sf):
    return rules.deceased_transferors(fx(spark, sf, "fx_owners"), fx(spark, sf, "fx_mutations"))


@query(
    "v4_unguarded_minors",
    ["fx_owners"],
    """select document_id, pos, name from fx_owners
       where lower(is_minor) in ('true', 'yes', 'नाबालिग', 'अल्पवयीन') and coalesce(father_husband, '') = ''""",
)
def minors(spark, sf):
    return rules.unguarded_minors(fx(spark, sf, "fx_owners")).select("document_id", "pos", "name")


@query(
    "v5_conversion_order",
    ["fx_records"],
    """select document_id, lower(land_class) land_class from fx_records
       where lower(land_class) in ('non_agricultural', 'commercial', 'na') and coalesce(na_order_ref, '') = ''""",
)
def conversion(spark, sf):
    out = rules.conversion_order(fx(spark, sf, "fx_records"), BOOK)
    return out.select("document_id", F.col("evidence")["land_class"].alias("land_class"))


@query(
    "v6_restricted_tenure",
    ["fx_records"],
    """select document_id, lower(ownership_type) tenure_type from fx_records
       where regexp_matches(lower(ownership_type), 'restricted|tribal|inam') and coalesce(tenure_perm_ref, '') = ''""",
)
def tenure(spark, sf):
    out = rules.restricted_tenure(fx(spark, sf, "fx_records"), BOOK)
    return out.select("document_id", F.col("evidence")["tenure_type"].alias("tenure_type"))


@query(
    "v7_duplicate_registry",
    ["fx_records"],
    """select r.document_id, r.reg_no, g.copies, (select min(o.document_id) from fx_records o where o.reg_no = r.reg_no and o.document_id <> r.document_id) conflicting_id
       from fx_records r join (select reg_no, count(*) copies from fx_records where reg_no <> '' group by reg_no having count(*) > 1) g on r.reg_no = g.reg_no""",
)
def duplicates(spark, sf):
    return rules.registration_conflicts(fx(spark, sf, "fx_records"))


@query(
    "v7_duplicate_holdings",
    ["fx_records"],
    """with k as (select document_id, lower(trim(village)) village, trim(survey_no) survey_no, coalesce(trim(sub_division), '-') sub_division from fx_records)
       select r.document_id, r.village, r.survey_no, r.sub_division, g.copies,
         (select min(o.document_id) from k o where o.village = r.village and o.survey_no = r.survey_no and o.sub_division = r.sub_division and o.document_id <> r.document_id) conflicting_id
       from k r join (select village, survey_no, sub_division, count(*) copies from k group by all having count(*) > 1) g
         on r.village = g.village and r.survey_no = g.survey_no and r.sub_division = g.sub_division""",
)
def duplicate_holdings(spark, sf):
    return rules.holding_conflicts(fx(spark, sf, "fx_records"))


LIMIT = """case when lower(land_class) = 'irrigated' then case lower(state) when 'uttar pradesh' then cast(7.30 as double) else cast(7.28 as double) end
      else case lower(state) when 'uttar pradesh' then cast(18.25 as double) else cast(21.85 as double) end end"""


@query(
    "v8_land_ceiling",
    ["fx_records"],
    f"select document_id, holding_ha, {LIMIT} ceiling_ha from fx_records where holding_ha > {LIMIT}",
)
def ceiling(spark, sf):
    return rules.over_ceiling(fx(spark, sf, "fx_records"), BOOK).select("document_id", "holding_ha", "ceiling_ha")


@query(
    "v8_owner_ceiling",
    ["fx_records"],
    f"""select owner_id, state, land_class, holding_ha, {LIMIT} ceiling_ha from (
          select owner_id, lower(state) state, case when lower(land_class) = 'irrigated' then 'irrigated' else 'dry' end land_class,
            cast(sum(cast(holding_ha as decimal(28,8))) as double) holding_ha from fx_records group by all) t where holding_ha > {LIMIT}""",
)
def owner_ceiling(spark, sf):
    return rules.owner_over_ceiling(fx(spark, sf, "fx_records"), BOOK)


@query(
    "v9_identifier_format",
    ["fx_records"],
    r"""select document_id, 'ulpin' field_name, trim(ulpin) "value" from fx_records where ulpin <> '' and not regexp_matches(trim(ulpin), '^[A-Z0-9]{14}$')
        union all select document_id, 'survey_no', trim(survey_no) from fx_records
        where survey_no <> '' and not regexp_matches(trim(survey_no), '^[0-9]+([/\\-][0-9A-Za-z]+)?$')""",
)
def identifiers(spark, sf):
    return rules.bad_identifiers(fx(spark, sf, "fx_records"))


@query(
    "v10_admin_hierarchy",
    ["fx_records"],
    f"""with a as (select * from {DIRECTORY})
        select r.document_id,
          case when not exists (select 1 from a where st = lower(trim(r.state))) then 'state'
            when not exists (select 1 from a where st = lower(trim(r.state)) and di = lower(trim(r.district))) then 'district'
            when not exists (select 1 from a where st = lower(trim(r.state)) and di = lower(trim(r.district)) and te = lower(trim(r.tehsil))) then 'tehsil'
            when not exists (select 1 from a where st = lower(trim(r.state)) and di = lower(trim(r.district)) and te = lower(trim(r.tehsil)) and vi = lower(trim(r.village))) then 'village' end failed_level
        from fx_records r""",
)
def hierarchy(spark, sf):
    return rules.hierarchy_check(fx(spark, sf, "fx_records")).select("document_id", "failed_level")


def all_results(spark, sf, book=BOOK):
    return rules.validate(
        fx(spark, sf, "fx_records"), fx(spark, sf, "fx_owners"), fx(spark, sf, "fx_mutations"), book, AS_OF
    )


IN_SCOPE = " ".join(
    f"when '{r.rule_id}' then "
    + ("true" if "all" in r.applies_to else "r.document_type in ('" + "', '".join(r.applies_to) + "')")
    for r in BOOK.rules.values()
)

RESULTS = f"""select document_id, '{rb.SHARES}' rule_id, case when abs(total_share - 1) > cast(0.01 as double) then 'failed' else 'passed' end status from ({SHARES}) t
    union all select distinct m.document_id, '{rb.HOLDING}', 'failed' from fx_mutations m join fx_records r on m.document_id = r.document_id
      where r.holding_sqm <> 0 and m.transferred_area > r.holding_sqm * cast(1.01 as double)
    union all select document_id, '{rb.CHRONOLOGY}', 'failed' from ({DATED}) t where d > date '{AS_OF}'
    union all select document_id, '{rb.CHRONOLOGY}', 'failed' from ({DATED}) t where d < g
    union all select o.document_id, '{rb.CAPACITY}', 'failed' from
         (select distinct document_id, name from fx_owners where lower(is_deceased) in ('true', 'yes', 'मृत') and name <> '') o
         join fx_mutations m on o.document_id = m.document_id where m.from_party <> '' and contains(lower(m.from_party), lower(o.name))
    union all select document_id, '{rb.CAPACITY}', 'failed' from fx_owners where lower(is_minor) in ('true', 'yes', 'नाबालिग', 'अल्पवयीन') and coalesce(father_husband, '') = ''
    union all select document_id, '{rb.CONVERSION}', 'failed' from fx_records where lower(land_class) in ('non_agricultural', 'commercial', 'na') and coalesce(na_order_ref, '') = ''
    union all select document_id, '{rb.TENURE}', 'failed' from fx_records where regexp_matches(lower(ownership_type), 'restricted|tribal|inam') and coalesce(tenure_perm_ref, '') = ''
    union all select document_id, '{rb.DUPLICATE}', 'failed' from fx_records where reg_no <> '' and reg_no in (select reg_no from fx_records group by reg_no having count(*) > 1)
    union all select document_id, '{rb.CEILING}', 'failed' from fx_records where holding_ha > {LIMIT}
    union all select document_id, '{rb.IDENTIFIER}', 'failed' from fx_records where ulpin <> '' and not regexp_matches(trim(ulpin), '^[A-Z0-9]{{14}}$')
    union all select r.document_id, '{rb.HIERARCHY}', case when a.st is null then 'failed' else 'passed' end from fx_records r
      left join (select * from {DIRECTORY}) a on st = lower(trim(r.state)) and di = lower(trim(r.district)) and te = lower(trim(r.tehsil)) and vi = lower(trim(r.village))"""

INPUTS = ["fx_records", "fx_owners", "fx_mutations"]


@query("k5_all_rule_results", INPUTS, f"select document_id, rule_id, status, '{LEGAL_DISCLAIMER}' disclaimer from ({RESULTS}) t")
def union_of_rules(spark, sf):
    return all_results(spark, sf).select("document_id", "rule_id", "status", "disclaimer")


@query(
    "v11_scoped_results",
    INPUTS,
    f"""select t.document_id, t.rule_id, t.status from ({RESULTS}) t join fx_records r on t.document_id = r.document_id
        where case t.rule_id {IN_SCOPE} end""",
)
def scoped(spark, sf):
    book = RuleBook(BOOK.rules, BOOK.ceilings, enforce_scope=True)
    return all_results(spark, sf, book).select("document_id", "rule_id", "status")


ORDER = q.text_list([r[0] for r in rb.RULES])


@query(
    "v12_validation_summary",
    INPUTS,
    f"""with s as (select document_id, count(*) evaluated, count(case when status = 'failed' then 1 end) failed,
            list_sort(list(distinct case when status = 'failed' then list_position({ORDER}, rule_id) end)) places from ({RESULTS}) t group by document_id)
        select r.document_id, coalesce(evaluated, 0) evaluated, coalesce(failed, 0) failed,
          case when evaluated is null then cast(1 as double) else {q.rounded("greatest(cast(0 as double), 1 - cast(failed as double) / cast(evaluated as double))", 3)} end score,
          coalesce(array_to_string(list_transform(list_filter(places, lambda p: p is not null), lambda p: ({ORDER})[p]), ','), '') failed_rules
        from fx_records r left join s on r.document_id = s.document_id""",
)
def summary(spark, sf):
    out = rules.summarize(fx(spark, sf, "fx_records"), all_results(spark, sf))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


@query(
    "s3_rule_overrides",
    [],
    f"""with o as (select {q.text_list([r[0] for r in rb.RULES])}[cast(event_id % 10 + 1 as int)] rule_id, ts, event_id id,
              case event_id % 3 when 0 then true when 1 then false end enabled,
              case when event_id % 4 = 0 then value end tolerance from events),
          b as (select * from {q.rows(["rule_id", "severity", "tolerance"], [(r[0], r[1], r[3]) for r in rb.RULES])})
        select b.rule_id, b.severity,
          coalesce((select arg_max(enabled, (ts, id)) from o where o.rule_id = b.rule_id and enabled is not null), true) enabled,
          cast(coalesce((select arg_max(tolerance, (ts, id)) from o where o.rule_id = b.rule_id and tolerance is not null), b.tolerance) as double) tolerance
        from b""",
)
def overrides(spark, sf):
    from landq.sources.readers import read_table

    ids = F.array(*[F.lit(r[0]) for r in rb.RULES])
    changes = read_table(spark, sf, "events").select(
        F.get(ids, (F.col("event_id") % 10).cast("int")).alias("rule_id"),
        "ts",
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False).alias("enabled"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("tolerance"),
    )
    out = rb.apply_overrides(rb.rules_table(spark), changes)
    return out.select("rule_id", "severity", "enabled", "tolerance")
