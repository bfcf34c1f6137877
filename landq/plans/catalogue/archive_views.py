"""Queries over ingest, listings, exports, masking, dashboards and event fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.operators import fanout, listing, lookup_index, masking, metrics, rules
from landq.operators import records as rec
from landq.plans.catalogue import legal
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.cadastral import parcels
from landq.plans.catalogue.registry import CATALOGUE, query
from landq.plans.catalogue.scoring import fields
from landq.plans.catalogue.workflow import ROLE
from landq.plans.fixtures import fx
from landq.schemas import PARCEL_FEATURES
from landq.session import shared_path
from landq.sources.dictionaries import (
    ADMIN_DIRECTORY,
    LAND_CLASSES,
    ROLE_PERMISSIONS,
    admin_hierarchy,
    inline_table,
    land_class_synonyms,
)
from landq.sources.readers import parcels_from_features, read_table
from landq.sources.sinks import features, write_stage

# ---------------------------------------------------------------- ingest and listings


def uploads(spark, sf):
    return read_table(spark, sf, "documents").select(
        F.col("text").cast("binary").alias("content"),
        F.concat(F.lit("scan/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"),
        F.col("doc_id").alias("ts"),
    )


def on_file(spark, sf):
    """Contents of one source count as already on file."""
    docs = read_table(spark, sf, "documents").filter(F.col("source") == "src0")
    return docs.select(F.sha2("text", 256).alias("sha256")).distinct()


UPLOADS = "select sha256(text) sha256, concat('scan/', lpad(cast(doc_id as varchar), 12, '0')) path, doc_id ts, source from documents"
FRESH = f"""select sha256, path from (select *, row_number() over (partition by sha256 order by ts, path) rn from ({UPLOADS}) u) t
    where rn = 1 and sha256 not in (select sha256(text) from documents where source = 'src0')"""


@query("s5_new_documents", sql=FRESH)
def new_documents(spark, sf):
    return listing.ingest(uploads(spark, sf), on_file(spark, sf))[0].select("sha256", "path")


@query(
    "s5_duplicate_uploads",
    sql=f"select u.sha256, u.path, f.path kept_path from ({UPLOADS}) u left join ({FRESH}) f on f.sha256 = u.sha256 where u.path is distinct from f.path",
)
def duplicate_uploads(spark, sf):
    return listing.ingest(uploads(spark, sf), on_file(spark, sf))[1].select("sha256", "path", "kept_path")


@query(
    "s6_document_page",
    ["fx_records"],
    "select document_id, status, doc_type from fx_records where status = 'published' and doc_type = '5-LOW' order by created_at desc, document_id limit 50 offset 100",
)
def document_page(spark, sf):
    out = listing.page(
        fx(spark, sf, "fx_records"), "created_at", "document_id", 100, 50, status="published", doc_type="5-LOW"
    )
    return out.select("document_id", "status", "doc_type")


@query(
    "k2_keyset_page",
    ["fx_records"],
    "select document_id from fx_records where created_at < timestamp '1997-01-01' or (created_at = timestamp '1997-01-01' and document_id > 10) order by created_at desc, document_id limit 50",
)
def keyset(spark, sf):
    at = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return listing.page_after(
        fx(spark, sf, "fx_records"), "created_at", "document_id", at, F.lit(10), 50
    ).select("document_id")


@query(
    "s7_search",
    ["fx_records"],
    "select document_id from fx_records where contains(lower(filename), 'n_12') or contains(lower(reg_no), 'n_12') or contains(lower(cast(document_id as varchar)), 'n_12')",
)
def search(spark, sf):
    return listing.search(fx(spark, sf, "fx_records"), "N_12", ["filename", "reg_no", "document_id"]).select("document_id")


TERMS = ["N_12", "reg-1", "scan_9", "no such term", "77"]


def _has(term: str) -> str:
    return " or ".join(f"contains(lower({c}), '{term.lower()}')" for c in ("filename", "reg_no", "cast(document_id as varchar)"))


@query(
    "s7_indexed_search",
    ["fx_records"],
    " union all ".join(f"select '{t}' term, document_id from fx_records where {_has(t)}" for t in TERMS),
)
def indexed_search(spark, sf):
    """The same search through a stored index of pieces of the texts."""
    path = shared_path(spark, "search")
    lookup_index.build_search_index(fx(spark, sf, "fx_records"), "document_id", ["filename", "reg_no", "document_id"], path)
    found = [lookup_index.search(spark, path, t).select(F.lit(t).alias("term"), F.col("id").alias("document_id")) for t in TERMS]
    return rec.union_all(found)


@query(
    "s6_deep_page",
    ["fx_records"],
    "select document_id, created_at from fx_records where status = 'published' order by created_at desc, document_id limit 40 offset 180",
)
def deep_page(spark, sf):
    """A page far behind the first one, which the index of places leads to."""
    path = shared_path(spark, "pages")
    lookup_index.build_page_index(fx(spark, sf, "fx_records"), "created_at", "document_id", path, ["status"])
    return lookup_index.page(spark, path, "created_at", "document_id", 180, 40, status="published").select("document_id", "created_at")


@query(
    "s8_document_view",
    ["fx_records", "fx_fields", "fx_mutations"],
    """select r.document_id, coalesce((select string_agg(concat(field_name, '=', value), ';' order by field_name, value) from fx_fields f where f.document_id = r.document_id), '') fields,
         (select count(*) from fx_mutations m where m.document_id = r.document_id) mutations from fx_records r""",
)
def document_view(spark, sf):
    children = {
        "fields": fx(spark, sf, "fx_fields").select("document_id", "field_name", "value"),
        "mutations": fx(spark, sf, "fx_mutations").select("document_id", "idx", "mutation_no"),
    }
    view = listing.document_view(fx(spark, sf, "fx_records").select("document_id"), children)
    pairs = F.transform("fields", lambda f: F.concat(f["field_name"], F.lit("="), f["value"]))
    return view.select(
        "document_id",
        F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("fields"),
        F.coalesce(F.size("mutations"), F.lit(0)).alias("mutations"),
    )


@query("s9_document_children", ["fx_mutations"], "select idx, mutation_no, from_party from fx_mutations where document_id = 77")
def children(spark, sf):
    return listing.children_of(fx(spark, sf, "fx_mutations"), 77).select("idx", "mutation_no", "from_party")


@query(
    "s10_audit_page",
    sql="select event_id from events where event_type = 'error' order by ts desc, event_id limit 40 offset 20",
)
def audit_page(spark, sf):
    return listing.page(read_table(spark, sf, "events"), "ts", "event_id", 20, 40, event_type="error").select("event_id")


@query("a3_recent_activity", sql="select event_id, event_type from events order by ts desc, event_id limit 10")
def recent(spark, sf):
    return metrics.recent_activity(read_table(spark, sf, "events"), 10, "event_id").select("event_id", "event_type")


# ---------------------------------------------------------------- exports

WIDE = "select document_id, " + ", ".join(
    f"max(case when field_name = '{n}' then value end) {n}" for n in ("owner_0_name", "survey_no", "ulpin", "village", "plot_area_value")
) + " from fx_fields group by document_id"
EXPORT = f"""select r.document_id, r.filename, r.status, r.overall_confidence, coalesce(w.ulpin, '') ulpin, coalesce(w.survey_no, '') survey_no, coalesce(w.village, '') village,
      coalesce(case when w.owner_0_name <> '' then {q.mask_name("w.owner_0_name")} end, 'Unknown') owner_name, coalesce(w.plot_area_value, '') area_sqm
    from fx_records r left join ({WIDE}) w on w.document_id = r.document_id"""


def export(spark, sf):
    return listing.export_rows(fx(spark, sf, "fx_records"), fields(spark, sf), "operator")


@query("s11_export_rows", ["fx_records", "fx_fields"], EXPORT)
def export_rows(spark, sf):
    return export(spark, sf).drop("doc_type", "land_type", "created_at")


@query(
    "s12_export_features",
    ["fx_records", "fx_fields", "fx_parcels"],
    f"""select cast(x.document_id as varchar) document_id, case when ord is null then null else 'Polygon' end geometry, x.owner_name from ({EXPORT}) x left join (
          select e.document_id, least(a.ord, b.ord) ord from ({EXPORT}) e
          left join (select ulpin, min(ord) ord from fx_parcels where ulpin <> '' group by ulpin) a on a.ulpin = e.ulpin
          left join (select lower(trim(village)) v, trim(survey_no) s, min(ord) ord from fx_parcels group by all) b on b.v = lower(trim(e.village)) and b.s = trim(e.survey_no)) g
        on g.document_id = x.document_id""",
)
def export_features(spark, sf):
    layer = parcels(spark, sf)
    lines = features(listing.export_geometry(export(spark, sf), layer), layer)
    path = lambda p: F.get_json_object("value", p)
    return lines.select(
        path("$.properties.document_id").alias("document_id"),
        path("$.geometry.type").alias("geometry"),
        path("$.properties.owner_name").alias("owner_name"),
    )


# ---------------------------------------------------------------- flattening

ITEMS = "o.document_id, o.document_type, o.survey_no, o.ulpin"


def nested_records(spark, sf):
    """Record documents put together from the tables: scalars, owners and mutations of each document.

    Rows are dealt by document before they are listed: a document has few, so lists made before that save nothing.
    """
    item = lambda c: F.struct(
        c.cast("string").alias("value"), c.cast("string").alias("raw_text"), F.lit(0.9).alias("confidence")
    )
    opt = lambda name: F.when(F.col(name).isNotNull(), item(F.col(name)))
    owners = (
        fx(spark, sf, "fx_owners")
        .repartition("document_id")
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "parcel_id", "name", "share", "father_husband", "is_minor", "is_deceased"))).alias("o"))
    )
    moves = (
        fx(spark, sf, "fx_mutations")
        .repartition("document_id")
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "parcel_id", "mutation_no", "mutation_date", "registration_date", "from_party", "to_party", "transferred_area", "order_ref", "mutation_type"))).alias("m"))
    )
    base = fx(spark, sf, "fx_records").join(owners, "document_id", "left").join(moves, "document_id", "left")
    empty = F.struct(
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("raw_text"), F.lit(None).cast("double").alias("confidence")
    )
    none = F.when(F.lit(False), empty)
    given = lambda c: F.when(c.isNotNull(), item(c))
    owner = F.transform(
        "o",
        lambda o: F.struct(
            item(o["name"]).alias("name"),
            given(o["father_husband"]).alias("father_or_husband_name"),
            item(o["share"]).alias("share"),
            given(o["is_minor"]).alias("is_minor"),
            given(o["is_deceased"]).alias("is_deceased"),
        ),
    )
    names = ["mutation_no", "mutation_date", "registration_date", "mutation_type", "from_party", "to_party", "transferred_area", "order_ref"]
    move = F.transform("m", lambda m: F.struct(*[given(m[n]).alias(n) for n in names]))
    extraction = F.struct(
        *[item(F.col(n)).alias(n) for n in ("document_type", "state", "district", "tehsil", "village", "survey_no")],
        none.alias("khasra_no"),
        none.alias("khata_no"),
        opt("sub_division").alias("sub_division"),
        opt("ulpin").alias("ulpin"),
        F.struct(item(F.col("holding_sqm")).alias("value"), item(F.lit("sqm")).alias("unit"), none.alias("area_sqm"), none.alias("area_hectares")).alias("plot_area"),
        item(F.col("land_class")).alias("land_classification"),
        opt("ownership_type").alias("ownership_type"),
        owner.alias("landowners"),
        move.alias("mutation_entries"),
        F.struct(item(F.col("reg_no")).alias("reg_no"), opt("reg_date").alias("reg_date"), none.alias("sub_registrar_office")).alias("registration"),
        none.alias("encumbrances_or_loans"),
        none.alias("remarks_or_annotations"),
        opt("na_order_ref").alias("na_conversion_order_ref"),
        opt("tenure_perm_ref").alias("restricted_tenure_permission_ref"),
    )
    return base.select("document_id", extraction.alias("extraction"))


SCALARS = {
    "document_type": "document_type", "state": "state", "district": "district", "tehsil": "tehsil", "village": "village",
    "survey_no": "survey_no", "sub_division": "sub_division", "ulpin": "ulpin", "plot_area_unit": "'sqm'",
    "land_classification": "land_class", "ownership_type": "ownership_type", "na_order_ref": "na_order_ref",
    "tenure_perm_ref": "tenure_perm_ref", "reg_no": "reg_no", "reg_date": "reg_date",
}
OWNED = {"name": "name", "share": "share", "father_husband": "father_husband", "is_minor": "is_minor", "is_deceased": "is_deceased"}
MOVED = {"no": "mutation_no", "date": "mutation_date", "reg_date": "registration_date", "from": "from_party", "to": "to_party", "order_ref": "order_ref"}
NO_NUMBER = 'cast(null as double) "number"'
FLAT = " union all ".join(
    [f"select document_id, '{n}' field_name, {c} \"value\", {NO_NUMBER} from fx_records where {c} is not null" for n, c in SCALARS.items()]
    + [f"select document_id, concat('owner_', p, '_{n}'), {c}, {NO_NUMBER} from o where {c} is not null" for n, c in OWNED.items()]
    + [f"select document_id, concat('mutation_', p, '_{n}'), {c}, {NO_NUMBER} from m where {c} is not null" for n, c in MOVED.items()]
    + ["select document_id, 'plot_area_value', null, cast(holding_sqm as double) from fx_records where holding_sqm is not null"]
    + ["select document_id, concat('mutation_', p, '_area'), null, cast(transferred_area as double) from m where transferred_area is not null"]
)
# the order in which lists of structs are sorted: all columns in turn, nulls first
OWNER_ORDER = ", ".join(f"{c} nulls first" for c in "pos parcel_id name share father_husband is_minor is_deceased".split())
MOVE_ORDER = ", ".join(
    f"{c} nulls first"
    for c in "idx parcel_id mutation_no mutation_date registration_date from_party to_party transferred_area order_ref mutation_type".split()
)


@query(
    "p1_flatten_record",
    ["fx_records", "fx_owners", "fx_mutations"],
    f"""with o as (select *, row_number() over (partition by document_id order by {OWNER_ORDER}) - 1 p from fx_owners where document_id in (select document_id from fx_records)),
        m as (select *, row_number() over (partition by document_id order by {MOVE_ORDER}) - 1 p from fx_mutations where document_id in (select document_id from fx_records)) {FLAT}""",
)
def flatten(spark, sf):
    rows = rec.flatten_fields(nested_records(spark, sf))
    name = F.col("field_name")
    numbers = (name == "plot_area_value") | (name.startswith("mutation_") & name.endswith("_area"))
    value = F.col("value")
    return rows.select(
        "document_id", "field_name", F.when(~numbers, value).alias("value"), F.when(numbers, value.try_cast("double")).alias("number")
    )


@query(
    "s1_record_tables",
    ["fx_records", "fx_owners", "fx_mutations"],
    """select r.document_id, r.village, r.land_class, r.reg_no, (select count(*) from fx_owners o where o.document_id = r.document_id) owners,
         (select count(*) from fx_mutations m where m.document_id = r.document_id) mutations from fx_records r""",
)
def record_tables(spark, sf):
    nested = nested_records(spark, sf)
    count = lambda df, n: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(n))
    out = (
        rec.scalar_records(nested)
        .join(count(rec.owner_rows(nested), "owners"), "document_id", "left")
        .join(count(rec.mutation_rows(nested), "mutations"), "document_id", "left")
    )
    zero = F.lit(0)
    return out.select(
        "document_id", "village", "land_class", "reg_no",
        F.coalesce("owners", zero).alias("owners"), F.coalesce("mutations", zero).alias("mutations"),
    )


# ---------------------------------------------------------------- sources and stage tables


@query(
    "s2_parcel_features",
    ["fx_parcels"],
    "select ulpin, survey_no, village, area_sqm, neighbour_a, cast(x0 as double) first_x, cast(y1 as double) third_y from fx_parcels",
)
def parcel_features(spark, sf):
    """Parcels written as GeoJSON collections and read back with the explicit schema."""
    props = F.struct("ulpin", "survey_no", "village", "tehsil", "district", "area_sqm", "neighbours")
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    body = F.struct(F.array(F.struct(props.alias("properties"), shape.alias("geometry"))).alias("features"))
    texts = parcels(spark, sf).select(F.to_json(body).alias("text"))
    collections = texts.select(F.from_json("text", PARCEL_FEATURES).alias("c")).select("c.features")
    at = lambda i: F.get("ring", F.lit(i))
    return parcels_from_features(collections).select(
        "ulpin",
        "survey_no",
        "village",
        "area_sqm",
        F.get("neighbours", F.lit(0)).alias("neighbour_a"),
        at(0)["x"].alias("first_x"),
        at(2)["y"].alias("third_y"),
    )


SYNONYMS = q.rows(["cls", "syn", "o"], [(c, s.lower(), i) for i, (c, names) in enumerate(LAND_CLASSES.items()) for s in names])


@query(
    "s4_dictionary_join",
    ["fx_records"],
    f"select r.document_id, d.cls canonical_class, d.o ord from fx_records r join (select * from {SYNONYMS}) d on d.syn = lower(r.land_class)",
)
def dictionary_join(spark, sf):
    known = land_class_synonyms(spark).withColumnRenamed("land_class", "canonical_class")
    records = fx(spark, sf, "fx_records").select("document_id", F.lower("land_class").alias("synonym"))
    return records.join(F.broadcast(known), "synonym").select("document_id", "canonical_class", "ord")


@query("s15_stage_table", sql=CATALOGUE["v9_identifier_format"].sql)
def stage_table(spark, sf):
    """A stage written twice for one batch date holds its rows once."""
    path = shared_path(spark, "stage")
    for _ in range(2):
        write_stage(rules.bad_identifiers(fx(spark, sf, "fx_records")), path, "2026-01-01")
    return spark.read.parquet(path).select("document_id", "field_name", "value")


# ---------------------------------------------------------------- masking and roles

KIND = """case when regexp_matches(field_name, 'ownership_type|_share$|_is_minor$|_is_deceased$|^share') then null
    when regexp_matches(field_name, 'aadhaar|uid|pan|mobile|phone') then 'id' when regexp_matches(field_name, 'owner|khatadar|holder|purchaser|seller|applicant|father') then 'person' end"""


@query(
    "p22_mask_fields",
    ["fx_fields"],
    f"select document_id, field_name, line_id, case when {KIND} = 'person' then {q.mask_name('value')} else value end \"value\" from fx_fields",
)
def mask_values(spark, sf):
    from landq.functions.text import mask_field

    return fields(spark, sf).select(
        "document_id", "field_name", "line_id", mask_field(F.col("field_name"), F.col("value")).alias("value")
    )


@query(
    "p23_mask_document",
    ["fx_fields"],
    f"""select document_id, field_name, line_id, case when {KIND} = 'person' then {q.mask_name('raw_text')} else raw_text end raw_text,
        case when {KIND} is not null then 'pii_masked:restricted_access' else '' end notes from fx_fields""",
)
def mask_document(spark, sf):
    out = masking.mask_fields(fields(spark, sf), "operator")
    return out.select("document_id", "field_name", "line_id", "raw_text", F.array_join("flags", ",").alias("notes"))


@query("p23_mask_owners", ["fx_owners"], f"select document_id, pos, {q.mask_name('name')} name from fx_owners")
def mask_owners(spark, sf):
    return masking.mask_owners(fx(spark, sf, "fx_owners"), "readonly_api").select("document_id", "pos", "name")


GRANTS = q.rows(["r", "permission"], [(r, p) for r, ps in ROLE_PERMISSIONS.items() for p in ps])


@query(
    "p24_permissions",
    ["fx_review"],
    f"select e.event_id, g.permission from fx_review e join (select * from {GRANTS}) g on g.r = {ROLE}",
)
def permissions(spark, sf):
    users = fx(spark, sf, "fx_review").select("event_id", "role")
    return masking.resolve_permissions(users).select("event_id", "permission")


# ---------------------------------------------------------------- dashboards


@query(
    "a1_dashboard",
    legal.INPUTS,
    f"""select total_documents, auto_accepted, pending_review, rejected, average_confidence, auto_accept_rate_pct, total_validations, failed_validations from
          (select count(*) total_documents, count(case when status in ('auto_accepted', 'certified') then 1 end) auto_accepted,
            count(case when status in ('field_review', 'document_review', 'uploaded', 'preprocessed') then 1 end) pending_review,
            count(case when status = 'rejected' then 1 end) rejected,
            {q.rounded("(cast(sum(cast(overall_confidence as decimal(28,10))) as double) / count(*))", 3)} average_confidence,
            {q.rounded("(count(case when status in ('auto_accepted', 'certified') then 1 end) * cast(100 as double) / count(*))", 1)} auto_accept_rate_pct from fx_records) d,
          (select count(*) total_validations, count(case when status = 'failed' then 1 end) failed_validations from ({legal.RESULTS}) r) v""",
)
def dashboard(spark, sf):
    return metrics.dashboard(fx(spark, sf, "fx_records"), legal.all_results(spark, sf)).drop("critical_flags")


@query("a2_type_distribution", ["fx_records"], "select doc_type, count(*) n from fx_records group by doc_type")
def distribution(spark, sf):
    return metrics.type_distribution(fx(spark, sf, "fx_records"))


@query("k7_chart_series", ["fx_records"], 'select doc_type "name", count(*) "value" from fx_records group by doc_type')
def series(spark, sf):
    return metrics.chart_series(metrics.type_distribution(fx(spark, sf, "fx_records")))


@query(
    "a2_place_rollup",
    ["fx_records"],
    "select state, district, tehsil, count(*) n from fx_records group by rollup(state, district, tehsil)",
)
def rollup(spark, sf):
    return metrics.place_rollup(fx(spark, sf, "fx_records"))


def _pct(part: str, whole: str) -> str:
    return q.rounded(f"({part} * cast(100 as double) / nullif({whole}, 0))", 1)


PUB = "count(case when status = 'published' then 1 end)"


@query(
    "a4_programme_kpis",
    ["fx_records"],
    f"""select doc_type, count(*) documents, {PUB} published, count(case when status in ('field_review', 'document_review', 'needs_review', 'maker_reviewed') then 1 end) in_review,
        count(case when status = 'rejected' then 1 end) rejected, {_pct(PUB, "count(*)")} computerization_pct,
        {_pct("count(case when status = 'published' and overall_confidence >= cast(0.9 as double) then 1 end)", PUB)} straight_through_pct from fx_records group by doc_type""",
)
def kpis(spark, sf):
    return metrics.programme_kpis(fx(spark, sf, "fx_records"), ["doc_type"])


@query(
    "a4_review_kpis",
    ["fx_tasks"],
    "select count(*) reviews, count(case when status in ('approved', 'verified') then 1 end) completed, count(case when status = 'maker_reviewed' then 1 end) maker_reviewed from fx_tasks",
)
def review_kpis(spark, sf):
    return metrics.review_kpis(fx(spark, sf, "fx_tasks"))


@query(
    "a4_linkage_kpi",
    ["fx_parcels"],
    f"select count(*) parcels, count(case when village <> '' then 1 end) linked, {_pct('''count(case when village <> '' then 1 end)''', 'count(*)')} linkage_pct from fx_parcels",
)
def linkage(spark, sf):
    mapped = parcels(spark, sf).withColumn("ring", F.when(F.col("village") != "", F.col("ring")))
    return metrics.linkage_kpi(mapped)


@query(
    "k6_supported_states",
    ["fx_records"],
    f"select distinct state from fx_records where lower(state) in ({', '.join(repr(s) for s in ADMIN_DIRECTORY)})",
)
def states(spark, sf):
    """States of the archive that the directory supports."""
    known = listing.supported_states(admin_hierarchy(spark))
    return fx(spark, sf, "fx_records").select("state").distinct().join(F.broadcast(known), "state", "left_semi")


# ---------------------------------------------------------------- fan-out

SUBSCRIBERS = [
    ("sub-01", ["purchase", "error"], "first-secret", True),
    ("sub-02", ["*", "view"], "second-secret", True),
    ("sub-03", ["signup"], "third-secret", False),
    ("sub-04", ["signup", "click"], "fourth-secret", True),
]


def subscriptions(spark):
    rows = inline_table(
        spark,
        ["subscription_id", "listed", "secret", "active"],
        [(i, ",".join(e), s, a) for i, e, s, a in SUBSCRIBERS],
    )
    return rows.withColumn("events", F.split("listed", ",")).drop("listed")


def deliveries(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    body = fanout.canonical_payload(
        F.col("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.struct("event_id", "user_id")
    )
    return fanout.outbox(fanout.match_subscriptions(events, subscriptions(spark)), body)


def _pads() -> list[tuple]:
    """Inner and outer key blocks of the signature, as hex."""
    out = []
    for i, listed, secret, active in SUBSCRIBERS:
        key = secret.encode().ljust(64, b"\0")
        for e in ["*"] if "*" in listed else listed:
            if active:
                out.append((i, e, bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()))
    return out


PADS = q.rows(["subscription_id", "ev", "ipad", "opad"], _pads())
BODY = """cast(to_json(struct_pack(data := struct_pack(event_id := e.event_id, user_id := e.user_id), event := e.event_type, "timestamp" := strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f'))) as varchar)"""
DELIVERIES = f"""select e.event_id, e.ts, p.subscription_id, {BODY} payload, sha256(unhex(p.opad) || unhex(sha256(unhex(p.ipad) || encode({BODY})))) signature
      from events e join (select * from {PADS}) p on p.ev = e.event_type or p.ev = '*'"""


@query("j12_match_subscriptions", sql=f"select event_id, subscription_id from ({DELIVERIES}) d")
def matches(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type")
    return fanout.match_subscriptions(events, subscriptions(spark)).select("event_id", "subscription_id")


@query("s16_signed_outbox", sql=f"select event_id, subscription_id, payload, signature from ({DELIVERIES}) d")
def signed(spark, sf):
    return deliveries(spark, sf).select("event_id", "subscription_id", "payload", "signature")


@query(
    "k3_latest_deliveries",
    sql=f"select event_id, subscription_id from ({DELIVERIES}) d order by ts desc, event_id desc, subscription_id limit 50",
)
def latest(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "ts")
    return fanout.latest(fanout.match_subscriptions(events, subscriptions(spark)), 50).select("event_id", "subscription_id")
