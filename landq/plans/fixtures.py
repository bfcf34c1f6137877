"""Land-record tables derived from the general test tables.

Each view is one SQL text that reads a whole table and means the same in Spark and in the engine that
checks the results. Names in braces are the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landq.sources.readers import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _pick(values: list[str], expression: str) -> str:
    """The value at position ``expression`` modulo the number of values."""
    return f"split_part('{'|'.join(values)}', '|', cast({expression} % {len(values)} + 1 as int))"


def _text(expression: str) -> str:
    return f"cast({expression} as varchar(20))"


def _date_text(day: str, key: str) -> str:
    """The date as text in one of three of the accepted forms."""
    y, m, d = (_text(f"{part}({day})") for part in ("year", "month", "day"))
    return (
        f"case {key} % 3 when 0 then concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')) "
        f"when 1 then concat({d}, '/', {m}, '/', {y}) "
        f"else concat(lpad({d}, 2, '0'), '.', lpad({m}, 2, '0'), '.', {y}) end"
    )


PARTIES = ["Ramesh Patil", "रमेश पाटील", "Suresh Joshi", "Anil", "Shri Vijay Kumar", "संजय यादव", "Kiran"]
SELLERS = ["Shri Ramesh Patil", "रमेश पाटील आणि इतर", "Suresh Joshi", "", "Anil Kumar", "संजय यादव", "Kiran Desai"]

VIEWS = {
    "fx_records": f"""
        select o_orderkey document_id, o_custkey owner_id,
          {_pick(["khatauni_7_12", "mutation_register", "sale_deed"], "o_orderkey")} document_type,
          {_pick(["Maharashtra", "Uttar Pradesh", "Bihar", "Goa"], "o_custkey")} state,
          {_pick(["Pune", "Lucknow", "Patna", "Pune"], "(o_custkey + (case when o_orderkey % 9 = 0 then 1 else 0 end))")} district,
          {_pick(["Haveli", "Malihabad", "Danapur", "Haveli"], "(o_custkey + (case when o_orderkey % 7 = 0 then 1 else 0 end))")} tehsil,
          {_pick(["Wagholi", "Kakori", "Digha", "Wagholi"], "(o_custkey + (case when o_orderkey % 5 = 0 then 1 else 0 end))")} village,
          concat({_text("o_orderkey % 2000")}, case when o_orderkey % 6 = 0 then ' A' else '' end) survey_no,
          case o_orderkey % 3 when 0 then '1' when 1 then '0' end sub_division,
          case o_orderkey % 17 when 0 then 'SHORT-ID' when 1 then cast(null as varchar(20))
            else concat('27HA', lpad({_text("o_orderkey")}, 10, '0')) end ulpin,
          o_totalprice / 2 holding_sqm, o_totalprice / 20000 holding_ha,
          {_pick(["irrigated", "unirrigated_dry", "non_agricultural", "Commercial", "barren_waste", "na"], "o_orderkey")} land_class,
          {_pick(["freehold", "tribal_restricted", "Inam", "government", "Restricted"], "o_orderkey")} ownership_type,
          case o_orderkey % 4 when 0 then 'NA/12' when 1 then '' end na_order_ref,
          case o_custkey % 4 when 0 then 'COLL/7' when 1 then '' end tenure_perm_ref,
          case when o_orderkey % 19 = 0 then '' else concat('REG-', {_text("o_orderkey % 9973")}) end reg_no,
          {_date_text("o_orderdate", "o_orderkey")} reg_date,
          {_pick(["published", "field_review", "document_review", "auto_accepted", "rejected", "maker_reviewed"], "o_custkey")} status,
          o_orderpriority doc_type,
          cast(o_orderkey * 37 % 1000 as double) / 1000 overall_confidence,
          concat('Scan_', {_text("o_orderkey")}, '.jpg') filename,
          o_orderdate created_at
        from {{orders}}""",
    "fx_owners": f"""
        select l_orderkey document_id, l_linenumber pos, l_partkey parcel_id,
          {_pick(PARTIES, "l_suppkey")} name,
          case l_suppkey % 3 when 0 then '' when 1 then 'B. Patil' end father_husband,
          {_pick(["1/2", "50%", "0.5", "1/4", "25 %", "1", "abc", "1/0", "1/3"], "l_partkey")} share,
          {_pick(["1/2", "50%", "0.5", "1/4", "25 %", "1", "abc", "1/0", "1/3"], "l_partkey")} share_raw,
          {_pick(["false", "true", "Yes", "अल्पवयीन", "no"], "l_partkey")} is_minor,
          {_pick(["false", "True", "मृत", "no"], "l_suppkey")} is_deceased
        from {{lineitem}}""",
    "fx_mutations": f"""
        select l_orderkey document_id, l_linenumber idx, l_partkey parcel_id,
          concat('M-', {_text("l_partkey % 50")}) mutation_no,
          {_date_text("l_shipdate", "l_suppkey")} mutation_date,
          case l_suppkey % 4 when 0 then {_date_text("l_shipdate", "(l_suppkey + 1)")} when 1 then '' end registration_date,
          {_pick(["sale", "inheritance", "gift"], "l_suppkey")} mutation_type,
          {_pick(SELLERS, "l_suppkey")} from_party,
          {_pick(PARTIES, "(l_suppkey + l_linenumber)")} to_party,
          l_extendedprice transferred_area,
          concat('REV/', {_text("l_suppkey")}) order_ref
        from {{lineitem}}""",
    "fx_fields": f"""
        select l_orderkey document_id, l_orderkey page_id, l_partkey line_id,
          case l_linenumber when 1 then 'owner_0_name' when 2 then 'survey_no' when 3 then 'plot_area_value'
            when 4 then 'reg_date' when 5 then 'owner_0_share' when 6 then 'ulpin' else 'village' end field_name,
          case l_linenumber when 1 then {_pick(PARTIES, "l_suppkey")}
            when 2 then concat({_text("l_partkey % 900")}, case when l_suppkey % 5 = 0 then '?' else '' end)
            when 3 then case when l_suppkey % 6 = 0 then '-1' when l_suppkey % 6 = 1 then 'forty' else {_text("l_partkey")} end
            when 4 then {_date_text("l_shipdate", "l_suppkey")}
            when 5 then {_pick(["1/2", "50%", "0.5", "half", ""], "l_suppkey")}
            when 6 then case when l_suppkey % 4 = 0 then 'BAD' else concat('27HA', lpad({_text("l_partkey")}, 10, '0')) end
            else {_pick(["Wagholi", "Kakori", "", "Digha"], "l_suppkey")} end value,
          concat('raw ', {_text("l_partkey % 100")}) raw_text,
          l_discount * 10 confidence, l_tax * 12 agreement,
          cast(l_linenumber as double) / 10 y0, cast(l_suppkey % 50 as double) / 100 x0,
          cast(l_linenumber as double) / 10 + cast(1 as double) / 16 y1,
          cast(l_suppkey % 50 as double) / 100 + cast(1 as double) / 4 x1
        from {{lineitem}}""",
    "fx_parcels": f"""
        select p_partkey ord, concat('27HA', lpad({_text("p_partkey * 5")}, 10, '0')) ulpin,
          concat({_text("p_partkey % 1000")}, case when p_partkey % 4 = 0 then '/1' else '' end) survey_no,
          {_pick(["Wagholi", "Kakori", "Digha Rural", "Wagholi Khurd", ""], "p_partkey")} village,
          {_pick(["Haveli", "Malihabad", "Danapur"], "p_partkey")} tehsil,
          {_pick(["Pune", "Lucknow", "Patna"], "p_partkey")} district,
          p_retailprice area_sqm,
          {_text("p_partkey % 1000 + 1")} neighbour_a, {_text("p_partkey % 1000 + 2")} neighbour_b,
          (p_partkey * 37) % 997 + 1000 * cast(floor(p_partkey / 2000) as bigint) x0,
          (p_partkey * 53) % 991 y0,
          (p_partkey * 37) % 997 + 1000 * cast(floor(p_partkey / 2000) as bigint) + p_size x1,
          (p_partkey * 53) % 991 + p_size y1
        from {{part}}""",
    "fx_points": """
        select event_id, value x, cast(user_id * 13 % 991 as double) + cast(1 as double) / 2 y from {events}""",
    "fx_pages": """
        select o_orderkey page_id, o_orderkey document_id,
          cast(o_custkey % 200 as double) blur_score, cast(o_custkey % 10 as double) / 10 fade_score,
          cast(o_orderkey % 5 as double) / 10 stain_coverage,
          cast(o_orderkey % 240 as double) blur, cast(o_custkey % 7 as double) / 10 fade,
          cast(o_orderkey % 6 as double) / 10 stain, cast(o_custkey % 3 as double) / 10 tear,
          o_orderkey % 4 = 0 no_tiles
        from {orders}""",
    "fx_tasks": f"""
        select c_custkey task_id, c_custkey document_id, c_custkey % 2 = 0 double_review_required,
          cast(c_custkey * 37 % 1000 as double) / 1000 uncertainty,
          {_pick(["needs_review", "maker_reviewed", "pending", "verified"], "c_custkey")} status,
          {_pick(["high", "medium", "low"], "c_custkey")} priority, c_acctbal created_at
        from {{customer}}""",
    "fx_review": f"""
        select event_id, user_id task_id, concat('u', {_text("event_id % 11")}) reviewer_id,
          {_pick(["admin", "officer", "reviewer_1", "operator", "Auditor", "verifier", "nobody"], "event_id")} role,
          case when event_type = 'error' then 'rejected' else 'approved' end action,
          case event_id % 5 when 0 then true when 1 then false end is_checker, ts
        from {{events}}""",
    "fx_overrides": f"""
        select event_id, cast(floor(event_id / 3) as bigint) document_id,
          {_pick(["survey_no", "owner_0_name", "village"], "event_id")} field_name,
          props new_value, concat('u', {_text("user_id")}) reviewer_id, ts
        from {{events}}""",
}


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of one directory."""
    sql = VIEWS[name]
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def oracle(views: list[str], sql: str) -> str:
    """SQL for the checking engine: the views as named subqueries, then the statement."""
    parts = []
    for name in views:
        body = VIEWS[name]
        for t in TABLES:
            body = body.replace(f"{{{t}}}", t)
        parts.append(f"{name} as ({body.strip()})")
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(parts)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(parts)}, {body[5:]}"
    return f"with {', '.join(parts)} {body}"
