import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landq.functions import geometry as G
from landq.operators import geo

LAYER = "ord long, ulpin string, survey_no string, village string, tehsil string, district string, area_sqm double, neighbours array<string>, ring array<struct<x:double,y:double>>"


def box(x, y, w=0.001, h=0.001):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return [(float(a), float(b)) for a, b in corners]


def layer(spark, *rows):
    return spark.createDataFrame(list(rows), LAYER)


def parcel(ord_, ring, survey="101", village="Wagholi", area=4046.86, ulpin=None, near=("102",)):
    return (ord_, ulpin or f"27HA10010001{ord_:02d}", survey, village, "Haveli", "Pune", area, list(near), ring)


def metres(lat):
    p = math.radians(lat)
    return (
        111132.954 - 559.822 * math.cos(2 * p) + 1.175 * math.cos(4 * p),
        111412.84 * math.cos(p) - 93.5 * math.cos(3 * p),
    )


def test_metric_area(spark):
    df = G.with_measures(layer(spark, parcel(1, box(73.978, 18.579))))
    per_lat, per_lon = metres(18.5795)
    assert df.select(G.metric_area(F.col("ring"))).first()[0] == pytest.approx(1e-6 * per_lat * per_lon, abs=0.02)


def test_shape_checks(spark):
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    dent = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    rows = [(1, box(0, 0)), (2, bow), (3, box(0, 0, 0.1, 0.001)), (4, dent), (5, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)])]
    got = {r.ord: r for r in geo.shape_checks(layer(spark, *[parcel(i, r) for i, r in rows])).collect()}
    assert [got[i].is_valid for i in range(1, 6)] == [True, False, True, True, False]
    assert got[1].aspect_ratio == pytest.approx(1.0, abs=0.02) and not got[1].is_sliver
    assert got[1].compactness == pytest.approx(math.pi / 4, abs=1e-3)
    assert got[3].is_sliver and got[3].aspect_ratio > 20
    assert got[2].validity_reason == "Self-intersection"


def test_overlap_of_any_simple_polygons():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], dtype=float)
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)], dtype=float)
    assert G.polygon_overlap(square, ell)[0] == pytest.approx(7.0)
    assert G.polygon_overlap(ell, ell + 0.5)[0] == pytest.approx(3.25)
    assert G.polygon_overlap(square, square[::-1] + [2, 2])[:3] == pytest.approx((4.0, 3.0, 3.0))
    assert G.polygon_overlap(square, square + [9, 0])[0] == 0


def test_grid_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    rings = []
    for i in range(120):
        x, y = rng.uniform(0, 30, 2)
        size = float(rng.choice([0.3, 1.0, 7.0]))
        turn = rng.uniform(0, np.pi / 2) if i % 3 else 0.0
        base = np.array([(0, 0), (size, 0), (size, size), (0, size), (0, 0)])
        c, s = np.cos(turn), np.sin(turn)
        rings.append([(float(a * c - b * s + x), float(a * s + b * c + y)) for a, b in base])
    shapes = geo.distinct_shapes(layer(spark, *[parcel(i, r) for i, r in enumerate(rings)]))
    got = {(r.i, r.j): r.overlap_area for r in geo.overlap_pairs(shapes).collect()}
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            area = G.polygon_overlap(np.array(rings[i]), np.array(rings[j]))[0]
            if area > geo.SIGNIFICANT:
                want[(i, j)] = area
    assert set(got) == set(want) and len(want) > 50
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_copies_count_without_pairs(spark):
    same = box(0, 0, 2, 2)
    df = layer(spark, *[parcel(i, same) for i in range(5)], parcel(5, box(1, 1, 2, 2)), parcel(6, box(9, 9)))
    shapes = geo.distinct_shapes(df)
    pairs = geo.overlap_pairs(shapes)
    assert pairs.count() == 1
    got = {r.ord: r.overlaps for r in geo.overlap_counts(df, pairs, shapes).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 6: 0}


def test_points_on_the_edge_are_outside(spark):
    df = layer(spark, parcel(1, box(0, 0, 2, 2)), parcel(2, box(1, 1, 2, 2)))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.0, 0.5), (4, 2.5, 2.5), (5, 9.0, 9.0)], "p int, x double, y double")
    got = {r.p: r.ord for r in geo.locate_points(points, df, "p").collect()}
    assert got == {1: 1, 2: 1, 4: 2}


def test_lookup_tiers(spark):
    df = layer(
        spark,
        parcel(1, box(0, 0), "101", "Kharadi", ulpin="27HA1001000101"),
        parcel(2, box(1, 0), "103/1", "Wagholi Khurd"),
        parcel(3, box(2, 0), "200", "Undri"),
        parcel(4, box(3, 0), "300", ""),
    )
    rows = [
        (1, "27ha1001000101 ", "999", None, "x"),
        (2, None, "103", "1", "wagholi"),
        (3, None, "200", "0", "Elsewhere"),
        (4, None, "300", None, "Anything"),
        (5, None, "777", None, "Undri"),
        (6, None, "200", None, ""),
    ]
    records = spark.createDataFrame(rows, "document_id int, ulpin string, survey_no string, sub_division string, village string")
    got = {r.document_id: (r.ord, r.tier) for r in geo.find_parcels(records, df).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (4, 2), 6: (3, 2)}


def test_cross_check(spark):
    df = layer(spark, parcel(1, box(73.978, 18.579), "101", near=("102", "105")), parcel(2, box(73.979, 18.579), "102", near=("101",)))
    rows = [
        (1, "101", "Wagholi", "Haveli", "Pune", 4046.86, {"north": "102"}),
        (2, "101", "Wagholi", "Haveli", "Pune", 4330.0, None),
        (3, "102", "Wagholi", "Haveli", "Nagpur", 9000.0, {"east": "7"}),
        (4, "999", "Wagholi", "Haveli", "Pune", 1.0, None),
    ]
    ddl = "document_id int, survey_no string, village string, tehsil string, district string, text_sqm double, boundaries map<string,string>"
    records = spark.createDataFrame(rows, ddl).withColumns({"ulpin": F.lit(None).cast("string"), "sub_division": F.lit(None).cast("string")})
    got = {r.document_id: r for r in geo.cross_check(records, df).collect()}
    assert (got[1].status, got[1].deviations) == ("pass", [])
    assert (got[2].status, got[2].deviations) == ("warn", ["moderate_area_mismatch:7.0%>5.0%"])
    assert got[3].status == "error"
    assert got[3].deviations == [
        "critical_area_mismatch:122.39%>10.0%",
        "district_mismatch:doc='Nagpur'_gis='Pune'",
        "east_neighbour_unmatched:doc='7'",
    ]
    assert (got[4].matched, got[4].status, got[4].deviations) == (False, "error", ["missing_cadastral_parcel"])


def test_crowded_cells_in_parts(spark):
    """A heap of shapes of one size in one grid cell, beside others: the same pairs, dealt in parts."""
    rng = np.random.default_rng(3)
    rings = [box(0.5 + x, 0.5 + y, 0.9, 0.9) for x, y in rng.random((60, 2)) / 20] + [box(x, y, w, w) for x, y, w in rng.random((80, 3)) * [6, 6, 1.5] + [0, 0, 0.01]]
    rings += [[(0.6, 0.2), (1.4, 0.6), (1.0, 1.4), (0.2, 1.0), (0.6, 0.2)]]
    shapes = geo.distinct_shapes(layer(spark, *[parcel(i, r) for i, r in enumerate(rings)]))
    plain = {(r.i, r.j): round(r.overlap_area, 9) for r in geo.overlap_pairs(shapes).collect()}
    dealt = {(r.i, r.j): round(r.overlap_area, 9) for r in geo.overlap_pairs(shapes, crowd=4).collect()}
    assert dealt == plain and len(plain) > 60 * 59 / 2


def test_grid_tables_are_never_broadcast(spark):
    """Files of narrow columns look small; rings and cells made of them must not pass through the driver."""
    rows = spark.range(300).selectExpr("id ord", "cast(id % 20 * 3 as double) x", "cast(floor(id / 20) * 3 as double) y")
    ell = F.expr("""array(named_struct('x', x, 'y', y), named_struct('x', x + 4, 'y', y), named_struct('x', x + 4, 'y', y + 2),
        named_struct('x', x + 2, 'y', y + 2), named_struct('x', x + 2, 'y', y + 4), named_struct('x', x, 'y', y + 4), named_struct('x', x, 'y', y))""")
    df = rows.select("ord", ell.alias("ring"))
    points = spark.range(50).selectExpr("id p", "cast(id as double) x", "cast(id as double) + 0.5 y")
    shapes = geo.distinct_shapes(df)
    pairs = geo.overlap_pairs(shapes)
    for out in (geo.locate_points(points, df, "p"), pairs, geo.overlap_counts(df, pairs, shapes)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_overlaps_of_many_pairs_are_those_of_each_pair():
    r = np.random.default_rng(3)
    turn = np.sort(r.uniform(0, 2 * np.pi, (2, 40, 6)), axis=2)
    a, b = (np.concatenate([p, p[:, :1]], axis=1) for p in np.stack([np.cos(turn), np.sin(turn)], axis=3) * r.uniform(0.5, 2, (2, 40, 6, 1)))
    b[::2] = b[::2, ::-1]
    a[0], b[1] = 0.0, 50.0
    many = G.polygon_overlaps(a, b)
    assert many[:2, 0].tolist() == [0.0, 0.0]
    assert many.tolist() == [list(G.polygon_overlap(p, q)) for p, q in zip(a, b)]


def test_areas_are_rounded_once(spark, tmp_path):
    """Parcel 89341 has just below 20,691,500 square metres: to two digits first, it would be 20,692 thousand."""
    from landq.plans.catalogue import CATALOGUE

    part = spark.range(89341, 89342).selectExpr("id p_partkey", "'blue rod' p_name", "'Brand#5' p_brand", "'SMALL' p_type", "41 p_size", "934.1D p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    assert CATALOGUE["g1_metric_area"].run(spark, str(tmp_path)).first().thousand_sqm == 20691


def test_rings_of_few_points_are_judged_together():
    """All rings of one length at a time, convex or not, with what each ring gives alone."""
    p = np.random.default_rng(2).uniform(0, 3, (200, 6, 2))
    p = np.concatenate([p, p[:, :1]], axis=1)
    valid, _, decided = G._sane_many(p[..., 0], p[..., 1])
    alone = [G._sane_one(ring) for ring in p]
    assert decided.all() and 0 < valid.sum() < 200
    assert valid.tolist() == [v for v, _ in alone]
    ell = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]) * np.array([[[1.0, 2.0]], [[3.0, 1.0]], [[1.0, 40.0]]])
    assert G._sane_many(ell[..., 0], ell[..., 1])[1].tolist() == pytest.approx([G._sane_one(ring)[1] for ring in ell])
