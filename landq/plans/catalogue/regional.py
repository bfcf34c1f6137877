"""Queries over normalization, names and string similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.functions import text
from landq.operators import confidence, evaluate, name_pairs
from landq.operators import normalize as norm
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.fixtures import fx
from landq.sources.dictionaries import (
    DEVANAGARI_DIGITS,
    DOCUMENT_TYPES,
    FIELD_LABELS,
    GUJARATI_DIGITS,
    HONORIFICS,
    LAND_CLASSES,
    LATIN_NAMES,
    STANDARD_UNITS,
    STATE_UNIT_FACTORS,
    STATE_UNITS,
    TELUGU_DIGITS,
)
from landq.sources.readers import read_table

DIGITS = DEVANAGARI_DIGITS + GUJARATI_DIGITS + TELUGU_DIGITS
ASCII = "0123456789" * 3


def rows(spark, sf, table, sql):
    """A projection of one whole table."""
    return spark.sql(sql, t=read_table(spark, sf, table))


@query(
    "p5_indic_digits",
    sql=f"""select p_partkey, translate(concat(translate(cast(p_partkey as varchar(20)), '0123456789', '{DEVANAGARI_DIGITS}'), '/',
        translate(cast(p_size as varchar(20)), '0123456789', '{TELUGU_DIGITS}')), '{DIGITS}', '{ASCII}') survey_no from part""",
)
def indic_digits(spark, sf):
    written = rows(
        spark,
        sf,
        "part",
        f"""select p_partkey, concat(translate(cast(p_partkey as string), '0123456789', '{DEVANAGARI_DIGITS}'), '/',
            translate(cast(p_size as string), '0123456789', '{TELUGU_DIGITS}')) raw from {{t}}""",
    )
    return written.select("p_partkey", text.indic_to_ascii(F.col("raw")).alias("survey_no"))


@query(
    "p6_date_parse",
    ["fx_mutations"],
    f"select document_id, idx, mutation_date, {q.date('mutation_date')} parsed from fx_mutations",
)
def date_parse(spark, sf):
    return fx(spark, sf, "fx_mutations").select(
        "document_id", "idx", "mutation_date", text.parse_date(F.col("mutation_date")).alias("parsed")
    )


@query("p7_share_parse", ["fx_owners"], f"select document_id, pos, share, {q.share('share')} fraction from fx_owners")
def share_parse(spark, sf):
    return fx(spark, sf, "fx_owners").select(
        "document_id", "pos", "share", text.parse_share(F.col("share")).alias("fraction")
    )


UNITS = ["guntha", "Acre.", "हेक्टर", "BIGHA", "katha", "marla", "sq m", "बिस्वा", "chain", "are.."]
STATES = ["Bihar", "UP", "Punjab ", "Goa", "", "West Bengal"]
AREAS = """select l_orderkey, l_linenumber, l_partkey,
      case when l_suppkey % 20 = 0 then cast(0 as double) else l_quantity end amount,
      split_part('{units}', '|', cast(l_partkey % {nu} + 1 as int)) unit,
      split_part('{states}', '|', cast(l_suppkey % {ns} + 1 as int)) state from {t}""".replace(
    "{units}", "|".join(UNITS)
).replace("{nu}", str(len(UNITS))).replace("{states}", "|".join(STATES)).replace("{ns}", str(len(STATES)))

SPELLINGS = q.rows(
    ["spelling", "unit_name", "factor", "low", "high"],
    [(s.lower(), u, f, None, None) for u, (f, names) in STANDARD_UNITS.items() for s in dict.fromkeys([u, *names])]
    + [(s.lower(), u, None, lo, hi) for u, (lo, hi, names) in STATE_UNITS.items() for s in dict.fromkeys([u, *names])],
)
FACTORS = q.rows(["u2", "st", "sf"], [(u, s, f) for u, d in STATE_UNIT_FACTORS.items() for s, f in d.items()])


@query(
    "p8_area_conversion",
    sql=f"""with a as ({AREAS.replace("{t}", "lineitem")}), k as (select * from {SPELLINGS}), f as (select * from {FACTORS}),
        j as (select a.*, k.unit_name, cast(k.factor as double) factor, cast(f.sf as double) sf, (cast(k.low as double) + cast(k.high as double)) / 2 mid from a
          left join k on k.spelling = regexp_replace(lower(trim(a.unit)), '\\.+$', '') left join f on f.u2 = k.unit_name and f.st = lower(trim(a.state)))
        select l_orderkey, l_linenumber, l_partkey,
          case when amount > 0 then {q.rounded("(amount * coalesce(factor, sf, mid, cast(1 as double)))", 4)} end area_sqm,
          case when amount > 0 then {q.rounded("(amount * coalesce(factor, sf, mid, cast(1 as double)) / 10000)", 6)} end area_hectares,
          case when not amount > 0 then 'invalid_or_zero_area' when factor is not null then 'converted_unit' when sf is not null then 'state_aware_conversion'
            when unit_name is not null then 'warning' else 'unmapped_area_unit' end kind from j""",
)
def area_conversion(spark, sf):
    out = norm.convert_area(rows(spark, sf, "lineitem", AREAS), "amount", "unit", "state")
    return out.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "area_sqm",
        "area_hectares",
        F.split_part(F.get("area_flags", F.lit(0)), F.lit(":"), F.lit(1)).alias("kind"),
    )


CLASSES = ["बागायत", "Irrigated ", "unirrigated", "असिंचित", "Barani", "jungle", "commercial", "NA", "pad zamin", "reservd forest", "grazing", "सरकारी वन", ""]
RAW_CLASS = f"split_part('{'|'.join(CLASSES)}', '|', cast(o_orderkey % {len(CLASSES)} + 1 as int))"
EXACT_CLASS = {s.lower(): c for c, names in LAND_CLASSES.items() for s in [c, *names]}
NEAR_CLASS = [
    (c, s.lower(), i) for i, (c, names) in enumerate(LAND_CLASSES.items()) for s in names if len(s) >= norm.SHORTEST_FUZZY
]
# windows of the longer text, shorter ones at its edges included
WINDOWS = """list_filter(list_transform(range(2 - length({s}), length({l}) + 1), lambda i:
      substring({l}, greatest(1, i), least(length({s}), length({s}) + i - 1))), lambda x: x <> '')"""


def _best_window(a: str, b: str) -> str:
    short, long = (
        f"(case when length({a}) <= length({b}) then {a} else {b} end)",
        f"(case when length({a}) <= length({b}) then {b} else {a} end)",
    )
    one = lambda s, l: f"list_max(list_transform({WINDOWS.format(s=s, l=l)}, lambda w: {q.ratio(s, 'w')}))"
    return f"(case when length({a}) = length({b}) then greatest({one(short, long)}, {one(long, short)}) else {one(short, long)} end)"


@query(
    "p9_land_class",
    sql=f"""with r as (select o_orderkey, {RAW_CLASS} raw from orders), d as (select distinct lower(trim(raw)) v from r where raw <> ''),
        e as (select v, ({q.text_map(EXACT_CLASS)})[v] exact from d),
        n as (select * from {q.rows(["cls", "syn", "ord"], NEAR_CLASS)}),
        p as (select v, syn, cls, ord, {_best_window("v", "syn")} score from e, n where exact is null),
        b as (select v, arg_min(cls, ord) near from p where score >= 88 group by v)
        select o_orderkey, case when raw = '' then 'unspecified' else coalesce(exact, near, raw) end land_class
        from r left join e on e.v = lower(trim(raw)) left join b on b.v = e.v""",
)
def land_class(spark, sf):
    raw = rows(spark, sf, "orders", f"select o_orderkey, {RAW_CLASS} raw from {{t}}")
    return norm.normalize_land_class(raw, "raw", "o_orderkey").select("o_orderkey", "land_class")


LABELS = ["Survey No.", "खसरा संख्या", "गट क्रमांक", "ownr name", "name father", "vilage", "Khatta no", "total aria", "??", "तालुका", "Zila", "registrar", "land clas"]
RAW_LABEL = f"split_part('{'|'.join(LABELS)}', '|', cast(l_partkey % {len(LABELS)} + 1 as int))"
EXACT_LABEL: dict[str, str] = {}
NEAR_LABEL = []
for _c, _names in FIELD_LABELS.items():
    for _s in _names:
        EXACT_LABEL.setdefault(_s.lower(), _c)
        NEAR_LABEL.append((_c, " ".join(sorted(_s.lower().split())), len(NEAR_LABEL)))
SORTED = "array_to_string(list_sort({words}), ' ')"


@query(
    "p10_field_labels",
    sql=f"""with r as (select l_orderkey, l_linenumber, l_partkey, {RAW_LABEL} raw from lineitem),
        d as (select distinct raw, lower(trim(raw)) lo, trim(regexp_replace(lower(trim(raw)), '{text.LABEL_PUNCTUATION}', '', 'g')) bare from r),
        e as (select raw, bare, {SORTED.format(words=q.words("bare"))} sorted, coalesce(({q.text_map(EXACT_LABEL)})[lo], ({q.text_map(EXACT_LABEL)})[bare]) exact from d),
        n as (select * from {q.rows(["cls", "syn", "ord"], NEAR_LABEL)}),
        p as (select raw, cls, ord, case when sorted = '' then cast(0 as double) else {q.ratio("sorted", "syn")} end score from e, n where exact is null),
        b as (select raw, arg_max(cls, (score, -ord)) near, max(score) score from p where score >= 80 group by raw)
        select l_orderkey, l_linenumber, l_partkey, coalesce(exact, near, r.raw) canonical_name,
          case when exact is not null then cast(1 as double) else coalesce({q.rounded("(score / 100)", 2)}, cast(0.5 as double)) end label_confidence
        from r join e on e.raw = r.raw left join b on b.raw = r.raw""",
)
def field_labels(spark, sf):
    raw = rows(spark, sf, "lineitem", f"select l_orderkey, l_linenumber, l_partkey, {RAW_LABEL} raw from {{t}}")
    return norm.canonicalize_labels(raw, "raw", "l_orderkey").drop("raw")


NAMES = ["श्री रमेश पाटील", "Shri. Ramesh Patil", "Smt Sunita  Deshmukh", "स्व. संजय यादव", "Dr. K. Rao", "कु. किरण मोरे", "Late Anil"]
RAW_NAME = f"split_part('{'|'.join(NAMES)}', '|', cast(c_custkey % {len(NAMES)} + 1 as int))"
TITLES = q.text_list(list(dict.fromkeys(h.replace(".", "") for h in HONORIFICS)))


def _stripped(x: str) -> str:
    return (
        f"array_to_string(list_filter({q.words(x)}, lambda w: not list_contains({TITLES}, "
        f"lower(regexp_replace(w, '{text.PUNCTUATION}', '', 'g')))), ' ')"
    )


def _latin(x: str) -> str:
    return f"array_to_string(list_transform({q.words(_stripped(x))}, lambda w: coalesce(({q.text_map(LATIN_NAMES)})[w], w)), ' ')"


@query(
    "p11_strip_honorifics",
    sql=f"select c_custkey, {_stripped('raw')} stripped_name from (select c_custkey, concat({RAW_NAME}, ' ', c_name) raw from customer) t",
)
def honorifics(spark, sf):
    raw = rows(spark, sf, "customer", f"select c_custkey, concat({RAW_NAME}, ' ', c_name) raw from {{t}}")
    return norm.latin_names(raw, "raw").select("c_custkey", "stripped_name")


@query(
    "p12_transliterate",
    sql=f"select c_custkey, {_latin('raw')} latin_name from (select c_custkey, concat({RAW_NAME}, ' ', c_name) raw from customer) t",
)
def transliterate(spark, sf):
    raw = rows(spark, sf, "customer", f"select c_custkey, concat({RAW_NAME}, ' ', c_name) raw from {{t}}")
    return norm.latin_names(raw, "raw").select("c_custkey", "latin_name")


@query(
    "p13_name_match",
    ["fx_mutations"],
    f"""with n as (select v, {SORTED.format(words=q.words(f"lower({_latin('v')})"))} s from (select distinct from_party v from fx_mutations union select distinct to_party from fx_mutations) u),
        s as (select a.v va, b.v vb, case when a.s = b.s then cast(100 as double) when a.s = '' or b.s = '' then cast(0 as double) else {q.ratio("a.s", "b.s")} end score from n a, n b)
        select document_id, idx, parcel_id, from_party, to_party, {q.rounded("(score / 100)", 2)} name_score, score >= 75 is_match
        from fx_mutations m join s on s.va = m.from_party and s.vb = m.to_party""",
)
def name_match(spark, sf):
    moves = fx(spark, sf, "fx_mutations").select("document_id", "idx", "parcel_id", "from_party", "to_party")
    return norm.match_names(moves, "from_party", "to_party")


ALL_NAMES = "select name v from fx_owners union select from_party from fx_mutations union select to_party from fx_mutations"
CLASSES = f"""select v name, {SORTED.format(words=q.words(f"lower({_latin('v')})"))} class from ({ALL_NAMES}) u where v is not null"""


def all_names(spark, sf):
    moves = fx(spark, sf, "fx_mutations")
    owners = fx(spark, sf, "fx_owners").select("name")
    return owners.unionAll(moves.select("from_party")).unionAll(moves.select("to_party"))


@query("p13_name_classes", ["fx_owners", "fx_mutations"], CLASSES)
def name_classes(spark, sf):
    return name_pairs.name_classes(all_names(spark, sf), "name")


@query(
    "p13_name_links",
    ["fx_owners", "fx_mutations"],
    f"""with c as (select distinct class from ({CLASSES}) x where class <> ''), p as (select a.class a, b.class b, {q.ratio("a.class", "b.class")} score from c a join c b on a.class < b.class)
        select a, b, {q.rounded("(score / 100)", 2)} name_score from p where score >= 75""",
)
def name_links(spark, sf):
    """Which of all owners and parties have like names: the archive's names against themselves."""
    return name_pairs.class_links(name_pairs.name_classes(all_names(spark, sf), "name"))


@query("p13_title_links")
def title_links(spark, sf):
    """The same over many different texts: the first three words of every document."""
    # cut before they are spelled, since documents are long
    first = F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), r"^\s*\S*\s*\S*\s*\S*", 0)
    titles = read_table(spark, sf, "documents").select(text.sorted_words(F.lower(first)).alias("class"))
    return name_pairs.class_links(titles)


def _type_sql(x: str) -> str:
    groups = " ".join(
        "when " + " or ".join(f"contains({x}, '{t}')" for t in terms) + f" then '{name}'"
        for name, _, terms in DOCUMENT_TYPES
    )
    return f"case {groups} else 'khatauni_7_12' end"


@query(
    "p14_document_type",
    sql=f"select doc_id, {_type_sql('lower(text)')} doc_type, case when {' or '.join(f'''contains(lower(text), '{t}')''' for _, _, ts in DOCUMENT_TYPES for t in ts)} then true else false end known from documents",
)
def document_type(spark, sf):
    kind = text.document_type(F.col("text"))
    out = read_table(spark, sf, "documents").select("doc_id", kind.alias("k"))
    return out.select("doc_id", F.col("k.doc_type").alias("doc_type"), (F.col("k.confidence") != 0.70).alias("known"))


@query("p20_mask_name", ["fx_owners"], f"select document_id, pos, {q.mask_name('name')} masked from fx_owners")
def mask_name(spark, sf):
    return fx(spark, sf, "fx_owners").select("document_id", "pos", text.mask_name(F.col("name")).alias("masked"))


IDS = """case l_partkey % 6 when 0 then lpad(cast(l_orderkey as varchar(20)), 12, '9') when 1 then concat('98765', lpad(cast(l_suppkey as varchar(20)), 5, '0'))
      when 2 then concat('ABCDE', lpad(cast(l_suppkey % 10000 as varchar(20)), 4, '0'), 'F') when 3 then concat(' 1234 5678 ', lpad(cast(l_suppkey % 10000 as varchar(20)), 4, '0'))
      when 4 then concat('V', cast(l_partkey as varchar(20)), 'Z1') else 'x1' end"""


@query(
    "p21_mask_id",
    sql=f"""select l_orderkey, l_linenumber, l_partkey, case when length(d) = 12 then concat('XXXX-XXXX-', right(d, 4)) when length(d) = 10 then concat('XXXXXX', right(d, 4))
          when regexp_matches(s, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') then concat('XXXXXX', right(s, 4))
          when length(s) > 4 then concat(repeat('*', length(s) - 4), right(s, 4)) else '****' end masked
        from (select *, trim(raw) s, regexp_replace(trim(raw), '[^0-9]', '', 'g') d from (select l_orderkey, l_linenumber, l_partkey, {IDS} raw from lineitem) a) b""",
)
def mask_id(spark, sf):
    raw = rows(spark, sf, "lineitem", f"select l_orderkey, l_linenumber, l_partkey, {IDS} raw from {{t}}")
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", text.mask_id(F.col("raw")).alias("masked"))


@query(
    "p26_finite",
    sql="select event_id, case when event_id % 3 = 0 or event_id % 5 = 0 then cast(0 as double) else value end clean from events",
)
def finite(spark, sf):
    dirty = rows(
        spark,
        sf,
        "events",
        "select event_id, case when event_id % 3 = 0 then double('NaN') when event_id % 5 = 0 then double('-Infinity') else value end v from {t}",
    )
    return dirty.select("event_id", text.finite(F.col("v")).alias("clean"))


@query("j9_engine_agreement")
def agreement(spark, sf):
    """A word of the next document is looked up in the whole text of this one."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    values = docs.select(
        (F.col("doc_id") - 1).alias("document_id"),
        F.lit("remarks").alias("field_name"),
        F.element_at(F.array_append(text.words(F.col("text")), F.lit("")), 1).alias("value"),
    ).withColumn("page_id", F.col("document_id"))
    texts = docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("page_id"), "text")
    return confidence.engine_agreement(values, texts)


WINDOWS = """range(1 - length(s), length(l))"""


@query(
    "j9_party_agreement",
    ["fx_mutations"],
    f"""with m as (select document_id, idx, parcel_id, lower(to_party) v, lower(from_party) t from fx_mutations),
        p as (select distinct v, t, case when length(v) <= length(t) then v else t end s, case when length(v) <= length(t) then t else v end l from m where v <> '' and t <> ''),
        d as (select v, t, s, l from p union all select v, t, l, s from p where length(s) = length(l)),
        w as (select v, t, s, l, unnest({WINDOWS}) i from d),
        c as (select v, t, s, substring(l, greatest(i, 0) + 1, i + length(s) - greatest(i, 0)) x from w),
        r as (select v, t, max({q.ratio("s", "x")}) score from c where x <> '' group by v, t)
        select m.document_id, m.idx, m.parcel_id, coalesce(case when contains(m.t, m.v) and m.v <> '' then cast(1 as double) when r.score is not null then greatest(cast(0.4 as double), {q.rounded("(r.score / 100)", 2)}) end, cast(0.95 as double)) agreement
        from m left join r on r.v = m.v and r.t = m.t""",
)
def party_agreement(spark, sf):
    """A receiving party's name looked up in the text that names the giving one: few pages, each asked for very often."""
    page = F.xxhash64("from_party").alias("document_id"), F.lit(0).alias("page_id")
    moves = fx(spark, sf, "fx_mutations")
    values = moves.select(*page, F.struct("document_id", "idx", "parcel_id").alias("at"), F.col("to_party").alias("value"))
    texts = moves.select("from_party").distinct().select(*page, F.col("from_party").alias("text"))
    return confidence.engine_agreement(values, texts).select("at.*", "agreement")


TRUTH = "select document_id, field_name, line_id, value from fx_fields"
READ = """case when line_id % 4 = 0 then concat(value, 'x') when line_id % 4 = 1 and length(value) > 1 then substring(value, 2) else value end"""
COMPARED = f"""select t.document_id, t.field_name, t.value true_value, r.read_value, trim(t.value) = trim(r.read_value) is_exact,
      case when trim(t.value) = trim(r.read_value) then cast(100 as double)
        when length(r.read_value) > length(t.value) then 200.0 * length(t.value) / (2 * length(t.value) + 1)
        else 200.0 * (length(t.value) - 1) / (2 * length(t.value) - 1) end similarity
    from (select document_id, field_name, min(value) "value" from fx_fields where value <> '' group by document_id, field_name) t
    join (select document_id, field_name, min(value) "value", {READ.replace("line_id", "min(line_id)").replace("value", "min(value)")} read_value
          from fx_fields where value <> '' group by document_id, field_name) r
      on t.document_id = r.document_id and t.field_name = r.field_name"""


def compared(spark, sf):
    one = (
        fx(spark, sf, "fx_fields")
        .filter(F.col("value") != "")
        .groupBy("document_id", "field_name")
        .agg(F.min("value").alias("value"), F.min("line_id").alias("line_id"))
    )
    read = one.select(
        "document_id", "field_name", F.expr(READ).alias("value"), F.lit(0.9).alias("confidence")
    )
    return evaluate.compare(one.drop("line_id"), read)


@query(
    "a9_field_accuracy",
    ["fx_fields"],
    f"""select field_name, count(*) n, count(case when is_exact then 1 end) exact, count(case when is_exact then 1 end) * cast(100 as double) / count(*) exact_pct,
        cast(sum(cast(similarity as decimal(28,8))) as double) / count(*) similarity_pct from ({COMPARED}) c group by field_name""",
)
def field_accuracy(spark, sf):
    return evaluate.field_accuracy(compared(spark, sf))


@query(
    "a9_language_performance",
    ["fx_fields", "fx_records"],
    f"""with d as (select document_id, count(case when is_exact then 1 end) / cast(count(*) as double) >= cast(0.85 as double) passed from ({COMPARED}) c group by document_id)
        select r.state "language", count(*) documents, count(case when passed then 1 end) * cast(100 as double) / count(*) passed_pct
        from fx_records r left join d on r.document_id = d.document_id group by r.state""",
)
def language_performance(spark, sf):
    docs = fx(spark, sf, "fx_records").select("document_id", F.col("state").alias("language"))
    return evaluate.language_performance(compared(spark, sf), docs)


@query(
    "a9_overall_accuracy",
    ["fx_fields"],
    f"select count(*) n, count(case when is_exact then 1 end) * cast(100 as double) / count(*) accuracy_pct from ({COMPARED}) c",
)
def overall_accuracy(spark, sf):
    return evaluate.overall_accuracy(compared(spark, sf))
