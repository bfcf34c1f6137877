"""Queries over parcels, points and the cadastral cross-check."""

from __future__ import annotations

from pyspark.sql import functions as F

from landq.functions import geometry as G
from landq.operators import geo, listing
from landq.plans.catalogue import sqltext as q
from landq.plans.catalogue.registry import query
from landq.plans.catalogue.scoring import fields
from landq.plans.fixtures import fx

# one square metre grid unit is taken as a thousandth of a degree near the equator where degrees matter
DEGREE = 1e-3


def parcels(spark, sf, scale: float = 1.0):
    """Parcels with rings; ``scale`` turns the integer grid into degrees."""
    df = fx(spark, sf, "fx_parcels")
    corners = [F.col(c) * F.lit(scale) for c in ("x0", "y0", "x1", "y1")]
    return df.withColumn("ring", G.box_ring(*corners)).withColumn("neighbours", F.array("neighbour_a", "neighbour_b"))


VARIANTS = """select document_id, upper(trim(ulpin)) ulpin, lower(trim(coalesce(village, ''))) village,
      lower(trim(survey_no)) s, lower(trim(coalesce(sub_division, ''))) h from fx_records"""
FOUND = f"""select document_id, ord, tier from (select document_id, ord, tier, row_number() over (partition by document_id order by tier, ord) rn from (
      select v.document_id, p.ord, 1 tier from ({VARIANTS}) v join fx_parcels p on length(v.ulpin) = 14 and upper(trim(p.ulpin)) = v.ulpin
      union all
      select v.document_id, p.ord, case when v.village = '' or contains(lower(trim(p.village)), v.village) or contains(v.village, lower(trim(p.village))) then 2 else 3 end
      from (select document_id, village, unnest(case when h in ('', '0') then [s] else [s, concat(s, '/', h), concat(s, '-', h)] end) survey from ({VARIANTS}) x) v
      join fx_parcels p on lower(trim(p.survey_no)) = v.survey) a) b where rn = 1"""


@query("j1_find_parcel", ["fx_records", "fx_parcels"], FOUND)
def find_parcel(spark, sf):
    return geo.find_parcels(fx(spark, sf, "fx_records"), parcels(spark, sf))


@query(
    "j5_neighbours",
    ["fx_parcels"],
    """with n as (select ulpin, lower(trim(village)) village, unnest([neighbour_a, neighbour_b]) neighbour_no from fx_parcels)
       select n.ulpin, n.neighbour_no, p.ulpin neighbour_ulpin from n left join fx_parcels p
         on lower(trim(p.village)) = n.village and lower(trim(p.survey_no)) = lower(trim(n.neighbour_no))""",
)
def neighbours(spark, sf):
    return geo.neighbours(parcels(spark, sf))


CLAIMS = {"north": "cast(ord % 1000 + 1 as varchar(20))", "south": "cast(ord % 777 as varchar(20))"}


@query(
    "j6_boundary_claims",
    ["fx_parcels"],
    " union all ".join(
        f"select ord, '{d}' direction, {c} claim from fx_parcels where not (contains(lower(neighbour_a), {c}) or contains(lower(neighbour_b), {c}))"
        for d, c in CLAIMS.items()
    ),
)
def boundary_claims(spark, sf):
    claims = F.create_map(*[x for d, c in CLAIMS.items() for x in (F.lit(d), F.expr(c).cast("string"))])
    open_claims = geo.unmatched_boundaries(claims, F.col("neighbours"))
    out = parcels(spark, sf).select("ord", F.explode(open_claims).alias("e"))
    return out.select("ord", F.col("e.key").alias("direction"), F.col("e.value").alias("claim"))


SHAPES = "select x0, y0, x1, y1, min(ord) shape_id, count(*) copies from fx_parcels group by x0, y0, x1, y1"
MEETS = "a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1"


@query(
    "j7_overlaps",
    ["fx_parcels"],
    f"""with s as ({SHAPES}) select a.shape_id i, b.shape_id j,
          cast((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as double) overlap_area
        from s a join s b on a.shape_id < b.shape_id and {MEETS}""",
)
def overlaps(spark, sf):
    return geo.overlap_pairs(geo.distinct_shapes(parcels(spark, sf))).select("i", "j", "overlap_area")


@query(
    "j7_overlap_counts",
    ["fx_parcels"],
    f"""with s as ({SHAPES}) select p.ord, cast((select coalesce(sum(b.copies), 0) from s b, s a where a.x0 = p.x0 and a.y0 = p.y0 and a.x1 = p.x1 and a.y1 = p.y1 and {MEETS}) - 1 as bigint) "overlaps"
        from fx_parcels p""",
)
def overlap_counts(spark, sf):
    layer = parcels(spark, sf)
    shapes = geo.distinct_shapes(layer)
    return geo.overlap_counts(layer, geo.overlap_pairs(shapes), shapes).select("ord", "overlaps")


@query(
    "j8_point_in_parcel",
    ["fx_points", "fx_parcels"],
    "select e.event_id, min(p.ord) ord from fx_points e join fx_parcels p on e.x > p.x0 and e.x < p.x1 and e.y > p.y0 and e.y < p.y1 group by e.event_id",
)
def point_in_parcel(spark, sf):
    return geo.locate_points(fx(spark, sf, "fx_points"), parcels(spark, sf), "event_id")


@query(
    "g1_planar_measures",
    ["fx_parcels"],
    "select ord, cast((x1 - x0) * (y1 - y0) as double) area, cast(2 * ((x1 - x0) + (y1 - y0)) as double) perimeter from fx_parcels",
)
def planar(spark, sf):
    ring = F.col("ring")
    return parcels(spark, sf).select("ord", G.ring_area(ring).alias("area"), G.ring_perimeter(ring).alias("perimeter"))


# ---------------------------------------------------------------- shapes that are no rectangles

# a square on its corner: |x - cx| + |y - cy| <= r; two of them meet in a rectangle of x + y and x - y
CX, CY, R = "(x0 + x1) / cast(2 as double)", "(y0 + y1) / cast(2 as double)", "(x1 - x0) / cast(2 as double)"
TURNED = f"select min(ord) id, u, v, r from (select ord, {CX} + {CY} u, {CX} - {CY} v, {R} r from fx_parcels) t group by u, v, r"


def turned(spark, sf):
    """Every parcel as a square on its corner."""
    cx, cy, r = (F.col(a) + F.col(b) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0")))
    cx, cy, r = cx / 2.0, cy / 2.0, (F.col("x1") - F.col("x0")) / 2.0
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(cx, cy - r), point(cx + r, cy), point(cx, cy + r), point(cx - r, cy), point(cx, cy - r))
    return fx(spark, sf, "fx_parcels").select("ord", ring.alias("ring"))


@query(
    "j7_turned_squares",
    ["fx_parcels"],
    f"""with s as ({TURNED}), p as (select least(a.id, b.id) i, greatest(a.id, b.id) j,
          (least(a.u + a.r, b.u + b.r) - greatest(a.u - a.r, b.u - b.r)) du, (least(a.v + a.r, b.v + b.r) - greatest(a.v - a.r, b.v - b.r)) dv from s a join s b on a.id < b.id)
        select i, j, round(du * dv / 2, 6) area from p where du > 0 and dv > 0""",
)
def turned_overlaps(spark, sf):
    found = geo.overlap_pairs(geo.distinct_shapes(turned(spark, sf)))
    return found.select("i", "j", F.round("overlap_area", 6).alias("area"))


# an L: the parcel without the upper right quarter of its box
CORNERED = """select x0, y0, x1, y1, (x0 + x1) / cast(2 as double) xm, (y0 + y1) / cast(2 as double) ym, min(ord) id from fx_parcels group by x0, y0, x1, y1"""


def ells(spark, sf):
    xm, ym = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    corners = [(x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0)]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    return fx(spark, sf, "fx_parcels").select("ord", ring.alias("ring"))


def _common(a: tuple, b: tuple) -> str:
    side = lambda low, high: f"greatest(0, least(a.{a[high]}, b.{b[high]}) - greatest(a.{a[low]}, b.{b[low]}))"
    return f"{side(0, 2)} * {side(1, 3)}"


WHOLE_BOX, QUARTER = ("x0", "y0", "x1", "y1"), ("xm", "ym", "x1", "y1")


@query(
    "j7_ell_overlaps",
    ["fx_parcels"],
    f"""with s as ({CORNERED}), p as (select a.id i, b.id j, cast({_common(WHOLE_BOX, WHOLE_BOX)} - {_common(WHOLE_BOX, QUARTER)} - {_common(QUARTER, WHOLE_BOX)} + {_common(QUARTER, QUARTER)} as double) area
          from s a join s b on a.id < b.id and {MEETS})
        select i, j, round(area, 6) area from p where area > 1e-9""",
)
def ell_overlaps(spark, sf):
    found = geo.overlap_pairs(geo.distinct_shapes(ells(spark, sf)))
    return found.select("i", "j", F.round("overlap_area", 6).alias("area"))


@query(
    "j8_points_in_ells",
    ["fx_points", "fx_parcels"],
    """select e.event_id, min(p.ord) ord from fx_points e join fx_parcels p on e.x > p.x0 and e.x < p.x1 and e.y > p.y0 and e.y < p.y1
        and not (e.x >= (p.x0 + p.x1) / cast(2 as double) and e.y >= (p.y0 + p.y1) / cast(2 as double)) group by e.event_id""",
)
def points_in_ells(spark, sf):
    return geo.locate_points(fx(spark, sf, "fx_points"), ells(spark, sf), "event_id")


@query(
    "g2_odd_shapes",
    ["fx_parcels"],
    """select ord, ord % 3 <> 1 is_valid, case when ord % 3 = 1 then 'Self-intersection' else 'Valid geometry' end validity_reason, ord % 3 <> 0 is_sliver from fx_parcels""",
)
def odd_shapes(spark, sf):
    """L shapes, crossed rings (whose halves cancel out, so they count as slivers too) and slivers: a third each."""
    kind, d = F.col("ord") % 3, F.lit(0.001)
    x0, y0, x1, y1 = (F.col(c) * d for c in ("x0", "y0", "x1", "y1"))
    xm, ym, thin = (x0 + x1) / 2.0, (y0 + y1) / 2.0, (x1 - x0) / 200.0
    ring = lambda *corners: F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    shape = (
        F.when(kind == 0, ring((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1), (x0, y0)))
        .when(kind == 1, ring((x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y0)))
        .otherwise(ring((x0, y0), (x1, y0), (x1, y0 + thin), (x0, y0 + thin), (x0, y0)))
    )
    out = geo.shape_checks(fx(spark, sf, "fx_parcels").select("ord", shape.alias("ring")))
    return out.select("ord", "is_valid", "validity_reason", "is_sliver")


def _metres(lat: str) -> tuple[str, str]:
    d = lambda v: f"cast({v} as double)"
    phi = f"radians({lat})"
    return (
        f"({d(111132.954)} - {d(559.822)} * cos(2 * {phi}) + {d(1.175)} * cos(4 * {phi}))",
        f"({d(111412.84)} * cos({phi}) - {d(93.5)} * cos(3 * {phi}))",
    )


# a box of a few degrees: the closed form agrees to far below a square metre, compared in whole thousands
LAT = "((y0 + y1) * cast(0.0005 as double))"
MLAT, MLON = _metres(LAT)


@query(
    "g1_metric_area",
    ["fx_parcels"],
    f"select ord, cast(round((x1 - x0) * (y1 - y0) * cast(0.000001 as double) * {MLAT} * {MLON} / 1000) as bigint) thousand_sqm from fx_parcels",
)
def metric_area(spark, sf):
    area = G.square_metres(F.col("ring"))
    return G.with_measures(parcels(spark, sf, DEGREE)).select("ord", F.round(area / 1000).cast("long").alias("thousand_sqm"))


W, H = f"((x1 - x0) * cast(0.001 as double) * {MLON})", f"((y1 - y0) * cast(0.001 as double) * {MLAT})"


@query(
    "g2_shape_sanity",
    ["fx_parcels"],
    f"""select ord, true is_valid, {q.rounded(f"(4 * pi() * {W} * {H} / ((2 * ({W} + {H})) * (2 * ({W} + {H}))))", 4)} compactness,
          {q.rounded(f"(greatest({W}, {H}) / greatest(cast(0.000000001 as double), least({W}, {H})))", 2)} aspect_ratio, false is_sliver from fx_parcels""",
)
def shape_sanity(spark, sf):
    return geo.shape_checks(parcels(spark, sf, DEGREE)).drop("validity_reason")


PCT = q.rounded("(abs(r.holding_sqm - p.area_sqm) / greatest(cast(1 as double), p.area_sqm) * cast(100 as double))", 2)


@query(
    "g3_area_deviation",
    ["fx_records", "fx_parcels"],
    f"""select document_id, pct, case when pct > 10 then 2 when pct > 5 then 1 else 0 end severity
        from (select r.document_id, case when r.holding_sqm > 0 then {PCT} end pct from fx_records r join fx_parcels p on r.document_id = p.ord) t""",
)
def area_deviation(spark, sf):
    p = parcels(spark, sf).select(F.col("ord").alias("document_id"), "area_sqm")
    pct = geo.area_deviation(F.col("holding_sqm"), F.col("area_sqm"))
    joined = fx(spark, sf, "fx_records").join(p, "document_id")
    return joined.select("document_id", pct.alias("pct"), geo.area_severity(pct).alias("severity"))


def _apart(c: str) -> str:
    d, g = f"lower(r.{c})", f"lower(p.{c})"
    return f"case when {d} <> '' and {g} <> '' and not contains({g}, {d}) and not contains({d}, {g}) then 1 else 0 end"


LEVELS = ("village", "tehsil", "district")


@query(
    "g4_admin_mismatch",
    ["fx_records", "fx_parcels"],
    f"select r.document_id, {' + '.join(_apart(c) for c in LEVELS)} mismatches from fx_records r join fx_parcels p on r.document_id = p.ord",
)
def admin_mismatch(spark, sf):
    p = parcels(spark, sf).select(F.col("ord").alias("document_id"), *[F.col(c).alias(f"gis_{c}") for c in LEVELS])
    notes = geo.admin_mismatches({c: (F.col(c), F.col(f"gis_{c}")) for c in LEVELS})
    joined = fx(spark, sf, "fx_records").join(p, "document_id")
    return joined.select("document_id", F.size(notes).alias("mismatches"))


@query(
    "g5_cross_check",
    ["fx_records", "fx_parcels"],
    f"""with s as ({SHAPES}), f as ({FOUND}),
        o as (select p.ord, (select coalesce(sum(b.copies), 0) from s b, s a where a.x0 = p.x0 and a.y0 = p.y0 and a.x1 = p.x1 and a.y1 = p.y1 and {MEETS}) - 1 n from fx_parcels p),
        c as (select r.document_id, f.ord, f.tier, {PCT} pct, {' + '.join(_apart(c) for c in LEVELS)} apart, o.n,
                case when contains(lower(p.neighbour_a), r.sub_division) or contains(lower(p.neighbour_b), r.sub_division) or r.sub_division is null then 0 else 1 end claims
              from fx_records r left join f on f.document_id = r.document_id left join fx_parcels p on p.ord = f.ord left join o on o.ord = f.ord)
        select document_id, ord is not null matched, tier, coalesce(pct, cast(0 as double)) discrepancy_pct, cast(n as bigint) "overlaps",
          case when ord is null then 'error' when pct > 10 or apart > 0 or n > 0 then 'error' when pct > 5 or claims > 0 then 'warn' else 'pass' end status,
          case when ord is null then 1 else cast(pct > 5 as int) + apart + claims + cast(n > 0 as int) end deviations from c""",
)
def cross_check(spark, sf):
    claims = F.when(F.col("sub_division").isNotNull(), F.create_map(F.lit("north"), F.col("sub_division"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    records = fx(spark, sf, "fx_records").withColumns({"text_sqm": F.col("holding_sqm"), "boundaries": claims})
    out = geo.cross_check(records, parcels(spark, sf, DEGREE))
    return out.select(
        "document_id", "matched", "tier", "discrepancy_pct", "overlaps", "status", F.size("deviations").alias("deviations")
    )


@query(
    "s14_village_parcels",
    ["fx_parcels"],
    "select ord, ulpin from fx_parcels where lower(trim(village)) = 'wagholi khurd'",
)
def village_parcels(spark, sf):
    return listing.parcels_of_village(parcels(spark, sf), " Wagholi Khurd ").select("ord", "ulpin")


@query(
    "j2_export_geometry",
    ["fx_records", "fx_parcels"],
    """select r.document_id, least(a.ord, b.ord) ord from fx_records r
       left join (select ulpin, min(ord) ord from fx_parcels where ulpin <> '' group by ulpin) a on a.ulpin = r.ulpin
       left join (select lower(trim(village)) v, trim(survey_no) s, min(ord) ord from fx_parcels group by all) b on b.v = lower(trim(r.village)) and b.s = trim(r.survey_no)""",
)
def export_geometry(spark, sf):
    return listing.export_geometry(fx(spark, sf, "fx_records"), parcels(spark, sf)).select("document_id", "ord")


@query(
    "j3_linked_parcels",
    ["fx_records", "fx_fields", "fx_parcels"],
    f"""with w as (select document_id, max(case when field_name = 'survey_no' then value end) s, lower(trim(max(case when field_name = 'village' then value end))) v,
              max(case when field_name = 'owner_0_name' then value end) o from fx_fields group by document_id),
        m as (select v, s, min(document_id) document_id from w where s <> '' group by v, s)
        select p.ord, m.document_id, case when m.document_id is null then null else {q.mask_name("coalesce(nullif(w.o, ''), 'Government / Unknown')")} end recorded_owner,
          case when m.document_id is null then 'unlinked' else r.status end verification_status
        from fx_parcels p left join m on m.v = lower(trim(p.village)) and m.s = trim(p.survey_no)
        left join w on w.document_id = m.document_id left join fx_records r on r.document_id = m.document_id""",
)
def linked_parcels(spark, sf):
    out = listing.linked_parcels(
        parcels(spark, sf), fx(spark, sf, "fx_records"), fields(spark, sf), role="readonly_api"
    )
    return out.select("ord", "document_id", "recorded_owner", "verification_status")
