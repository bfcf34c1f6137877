"""Parcel lookup, grid spatial joins and the cadastral cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions import geometry as G
from landq.functions.text import round_to
from landq.operators.ordered import hot_keys
from landq.session import written

SIGNIFICANT = 1e-9
SLIVER = 0.015
LONGEST_ASPECT = 20.0
WARN_PCT, ERROR_PCT = 5.0, 10.0
# the place of a parcel in the file and the tier of a match share one sortable number
TIER_SHIFT = 56
#: Shapes of a grid cell from which on they are dealt in so many parts.
CROWD, CROWD_PARTS = 5000, 64


def _dealt(df: DataFrame) -> DataFrame:
    """For joins whose both sides grow with the archive. A plan guesses sizes from the files of a few narrow columns, and
    what is made of them (rings, cells, notes) is far larger: a side that looked small would pass through the driver."""
    return df.hint("merge")


def _spread(df: DataFrame) -> DataFrame:
    """A small file of parcels is read in one task; what is made of it is dealt to many."""
    return df.repartition("ord")


# ---------------------------------------------------------------- lookup


def survey_variants(survey: Column, hissa: Column) -> Column:
    """s, s/h and s-h; the last two only for a real sub-division."""
    s, h = F.lower(F.trim(F.coalesce(survey, F.lit("")))), F.lower(F.trim(F.coalesce(hissa, F.lit(""))))
    whole = (h == "") | (h == "0")
    return F.array_compact(
        F.array(
            s,
            F.when(~whole, F.concat(s, F.lit("/"), h)),
            F.when(~whole, F.concat(s, F.lit("-"), h)),
        )
    )


GRAM = 3


def _pieces(value: Column, size: int) -> Column:
    """Distinct pieces of this many characters; none of a shorter name."""
    n = F.length(value)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda at: F.substring(value, at, F.lit(size)))
    return F.when(n >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _held_names(small: DataFrame, large: DataFrame, s: str, l: str) -> DataFrame:
    """Pairs of distinct names with ``s`` inside ``l``: they meet on the piece of ``s`` that the fewest names have.

    Pieces have three characters, those of shorter names are these names. A name gives one row for each of its places.
    """
    sizes = F.concat(*[_pieces(F.col(l), size) for size in range(1, GRAM + 1)])
    pieces = large.select(l, F.explode(sizes).alias("_piece"))
    counts = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length(s) >= GRAM, _pieces(F.col(s), GRAM)).otherwise(F.array(s))
    rarest = small.select(s, F.explode(own).alias("_piece")).join(counts, "_piece")
    rarest = rarest.groupBy(s).agg(F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
    return rarest.join(pieces, "_piece").filter(F.col(l).contains(F.col(s))).select(s, l)


def contained_names(asked: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of non-empty names where one contains the other, by an equi-join on rare pieces of names."""
    asked, known = (d.filter(F.col(c) != "").select(c).distinct() for d, c in ((asked, a), (known, b)))
    return _held_names(asked, known, a, b).union(_held_names(known, asked, b, a).select(a, b)).distinct()


def find_parcels(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """document_id, ord, tier: first parcel by land id, else by survey and village, else by survey.

    ``parcels`` has ``ord``, its place in the source. Parcels and requests are reduced to one row per
    (survey, village) first, and village names that contain one another are paired once per name, so a
    survey number that many villages use never pairs all requests with all parcels.
    """
    lookups = records.select(
        "document_id",
        F.upper(F.trim("ulpin")).alias("ulpin"),
        F.lower(F.trim(F.coalesce("village", F.lit("")))).alias("village"),
        survey_variants(F.col("survey_no"), F.col("sub_division")).alias("variants"),
    )
    places = parcels.select(
        "ord",
        F.upper(F.trim("ulpin")).alias("ulpin"),
        F.lower(F.trim(F.coalesce("survey_no", F.lit("")))).alias("survey"),
        F.lower(F.trim(F.coalesce("village", F.lit("")))).alias("p_village"),
    )
    rank = lambda tier: F.col("ord") + F.shiftleft(F.lit(tier).cast("long"), TIER_SHIFT)
    by_id = places.groupBy("ulpin").agg(F.min("ord").alias("ord"))
    first = lookups.filter(F.length("ulpin") == 14).join(_dealt(by_id), "ulpin").select("document_id", rank(1).alias("rank"))

    by_village = places.groupBy("survey", "p_village").agg(F.min("ord").alias("ord"))
    # a parcel without a village suits every request; a request without one takes any parcel of the survey
    by_survey = by_village.groupBy("survey").agg(
        F.min("ord").alias("any_ord"), F.min(F.when(F.col("p_village") == "", F.col("ord"))).alias("open_ord")
    )
    asked = lookups.select("document_id", "village", F.explode("variants").alias("survey"))
    requests = asked.select("survey", "village").distinct()
    names = contained_names(requests, by_village, "village", "p_village")
    near = (
        requests.join(names, "village")
        .join(_dealt(by_village), ["survey", "p_village"])
        .select("survey", "village", rank(2).alias("rank"))
    )
    free = F.when(F.col("village") == "", F.col("any_ord")).otherwise(F.col("open_ord"))
    loose = requests.join(_dealt(by_survey), "survey").select(
        "survey",
        "village",
        F.least(
            free + F.shiftleft(F.lit(2).cast("long"), TIER_SHIFT),
            F.col("any_ord") + F.shiftleft(F.lit(3).cast("long"), TIER_SHIFT),
        ).alias("rank"),
    )
    answers = near.unionByName(loose).groupBy("survey", "village").agg(F.min("rank").alias("rank"))
    second = asked.join(_dealt(answers), ["survey", "village"]).select("document_id", "rank")
    best = first.unionByName(second).groupBy("document_id").agg(F.min("rank").alias("rank"))
    tier = F.shiftright("rank", TIER_SHIFT)
    return best.select(
        "document_id",
        (F.col("rank") - F.shiftleft(tier, TIER_SHIFT)).alias("ord"),
        tier.cast("int").alias("tier"),
    )


def neighbours(parcels: DataFrame) -> DataFrame:
    """ulpin, neighbour_no, neighbour_ulpin: listed neighbours found in the same village."""
    listed = parcels.select(
        "ulpin", F.lower(F.trim("village")).alias("village"), F.explode("neighbours").alias("neighbour_no")
    ).withColumn("key", F.lower(F.trim("neighbour_no")))
    known = parcels.select(
        F.col("ulpin").alias("neighbour_ulpin"),
        F.lower(F.trim("village")).alias("village"),
        F.lower(F.trim("survey_no")).alias("key"),
    )
    return listed.join(known, ["village", "key"], "left").select("ulpin", "neighbour_no", "neighbour_ulpin")


def unmatched_boundaries(boundaries: Column, listed: Column) -> Column:
    """Boundary claims (map direction -> survey) that no listed neighbour contains."""
    return F.filter(
        F.map_entries(boundaries),
        lambda e: ~F.exists(
            F.coalesce(listed, F.array().cast("array<string>")),
            lambda n: F.lower(n).contains(F.lower(F.trim(e["value"]))),
        ),
    )


# ---------------------------------------------------------------- grid


def _level(box: Column) -> Column:
    """Power of two at or above the longer side: a shape's own cells are about its size."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"], F.lit(1e-12))
    return F.ceil(F.log2(side)).cast("int")


def _cells(box: Column, level: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    span = lambda low, high: F.sequence(
        F.floor(box[low] / size).cast("long"), F.floor(box[high] / size).cast("long")
    )
    return F.flatten(
        F.transform(
            span("x0", "x1"),
            lambda cx: F.transform(span("y0", "y1"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))),
        )
    )


def levels_of(shapes: DataFrame) -> tuple[list[int], bool]:
    """Grid levels in use, and whether all shapes are rectangles.

    The levels are powers of two between the smallest and the largest side: a few dozen rows at most.
    """
    found = shapes.select(_level(F.col("box")).alias("level"), "boxy").distinct().collect()
    return sorted({r["level"] for r in found}), all(r["boxy"] for r in found)


def distinct_shapes(parcels: DataFrame) -> DataFrame:
    """One row per ring: shape_id (smallest ord), ring, box, boxy, copies.

    Copies of one polygon collapse here, so that a heap of them does not pair with itself. Written out: the grid reads
    the shapes for its levels, its crowded cells and both sides of each join.
    """
    keyed = _spread(parcels.select("ord", "ring")).withColumn("_h", F.xxhash64("ring"))
    grouped = keyed.groupBy("_h", "ring").agg(F.min("ord").alias("shape_id"), F.count(F.lit(1)).alias("copies"))
    boxed = grouped.withColumn("box", G.bounding_box(F.col("ring")))
    return written(boxed.select("shape_id", "ring", "box", G.is_box(F.col("ring"), F.col("box")).alias("boxy"), "copies"), "shapes")


def _touching(large: DataFrame, small: DataFrame, levels: list[int], crowd: int = CROWD) -> DataFrame:
    """Pairs (a of ``large``, b of ``small``) whose boxes share area, with their boxes and rings.

    Every shape stands in its own level's cells and visits the coarser levels' cells it lies in, so small
    and large shapes meet without a fine grid under large shapes. A pair is kept in one cell only: the one
    with the lower-left corner of the common part; of two shapes of one level the first counts as large.
    """
    sided = lambda df: df.select(
        F.col("shape_id").alias("id"), "box", "ring", _level(F.col("box")).alias("own")
    )
    side = lambda n: [F.col(c).alias(f"{n}_{c}") for c in ("id", "box", "ring")]
    homes = sided(large).select(
        *side("a"), F.col("own").alias("level"), F.explode(_cells(F.col("box"), F.col("own"))).alias("cell")
    )
    cell_keys = ["level", "cell"]
    crowded = hot_keys(homes, cell_keys, crowd)
    coarser = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("own"))
    visits = (
        sided(small)
        .withColumn("level", F.explode(coarser))
        .withColumn("cell", F.explode(_cells(F.col("box"), F.col("level"))))
        .select(*side("b"), "own", "level", "cell")
    )
    a, b = F.col("a_box"), F.col("b_box")
    size = F.pow(F.lit(2.0), F.col("level"))
    shared = (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    here = (F.floor(F.greatest(a["x0"], b["x0"]) / size) == F.col("cell.cx")) & (
        F.floor(F.greatest(a["y0"], b["y0"]) / size) == F.col("cell.cy")
    )
    once = (F.col("own") < F.col("level")) | (F.col("a_id") < F.col("b_id"))
    keys = cell_keys
    if crowded is not None:
        # shapes of a crowded cell are dealt in parts, and those that visit it meet every part
        keys, hot = [*cell_keys, "part"], crowded.withColumn("hot", F.lit(True))
        homes = homes.join(hot, cell_keys, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("a_id"), F.lit(CROWD_PARTS)).cast("int")).otherwise(0)).drop("hot")
        parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(CROWD_PARTS - 1))).otherwise(F.array(F.lit(0)))
        visits = visits.join(hot, cell_keys, "left").withColumn("part", F.explode(parts)).drop("hot")
    return homes.join(_dealt(visits), keys).filter(shared & here & once).select("a_id", "a_box", "a_ring", "b_id", "b_box", "b_ring")


def overlap_pairs(shapes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """i, j, overlap_area (squared ring units), overlap_sqm for distinct shapes with a common part.

    Two rectangles have a closed form and stay out of Python; pairs with any other shape are clipped
    exactly in Arrow batches.
    """
    levels, only_boxes = levels_of(shapes)
    boxy = shapes if only_boxes else shapes.filter("boxy")
    a, b = F.col("a_box"), F.col("b_box")
    left, right = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])
    low, high = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    ends = [F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j")]
    measured = _touching(boxy, boxy, levels, crowd).select(
        *ends, ((right - left) * (high - low)).alias("overlap_area"), ((low + high) / 2.0).alias("_lat")
    )
    if not only_boxes:
        other = shapes.filter(~F.col("boxy"))
        rest = _touching(other, shapes, levels, crowd).unionByName(_touching(boxy, other, levels, crowd))
        clipped = rest.select(*ends, G.ring_overlap(F.col("a_ring"), F.col("b_ring")).alias("_clip"))
        measured = measured.unionByName(
            clipped.select("i", "j", F.col("_clip.area").alias("overlap_area"), F.col("_clip.cy").alias("_lat"))
        )
    per_lat, per_lon = G.metres_per_degree(F.col("_lat"))
    return measured.filter(F.col("overlap_area") > SIGNIFICANT).select(
        "i", "j", "overlap_area", round_to(F.col("overlap_area") * per_lat * per_lon, 2).alias("overlap_sqm")
    )


def overlap_counts(parcels: DataFrame, pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """ord, overlaps: number of other parcels that overlap each parcel, copies included, without
    writing out the pairs of copies."""
    sizes = shapes.select("shape_id", "copies")
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    ends = pairs.select(F.explode(both).alias("e")).select("e.i", "e.j")
    met = (
        ends.join(_dealt(sizes), ends.j == sizes.shape_id)
        .groupBy("i")
        .agg(F.sum("copies").alias("others"))
    )
    area = G.ring_area(F.col("ring"))
    per_shape = shapes.join(_dealt(met), shapes.shape_id == met.i, "left").select(
        "shape_id",
        F.xxhash64("ring").alias("_h"),
        "ring",
        (F.coalesce("others", F.lit(0)) + F.when(area > SIGNIFICANT, F.col("copies") - 1).otherwise(0)).alias("overlaps"),
    )
    return (
        parcels.select("ord", "ring", F.xxhash64("ring").alias("_h"))
        .join(_dealt(per_shape), ["_h", "ring"])
        .select("ord", "shape_id", "overlaps")
    )


def locate_points(points: DataFrame, parcels: DataFrame, point_id: str) -> DataFrame:
    """point id, ord of the first parcel that contains the point strictly inside.

    Equal points and equal polygons are looked up once.
    """
    shapes = distinct_shapes(parcels)
    levels, _ = levels_of(shapes)
    places = points.select("x", "y").distinct()
    visits = places.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = F.pow(F.lit(2.0), F.col("level"))
    visits = visits.withColumn(
        "cell",
        F.struct(F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy")),
    )
    homes = shapes.withColumn("level", _level(F.col("box"))).withColumn(
        "cell", F.explode(_cells(F.col("box"), F.col("level")))
    )
    box = F.col("box")
    near = (
        (F.col("x") >= box["x0"]) & (F.col("x") <= box["x1"]) & (F.col("y") >= box["y0"]) & (F.col("y") <= box["y1"])
    )
    inside = G.contains_point(F.col("ring"), F.col("x"), F.col("y"))
    found = visits.join(_dealt(homes), ["level", "cell"]).filter(near).filter(inside)
    first = found.groupBy("x", "y").agg(F.min("shape_id").alias("ord"))
    return points.join(_dealt(first), ["x", "y"]).select(point_id, "ord")


# ---------------------------------------------------------------- checks


def shape_checks(parcels: DataFrame) -> DataFrame:
    """ord, is_valid, reason, compactness, aspect_ratio, is_sliver; metres, not degrees."""
    ring = F.col("ring")
    measured = G.with_measures(_spread(parcels.select("ord", "ring")))
    checked = measured.select("ord", G.compactness(ring).alias("c"), G.ring_sanity(ring).alias("s"))
    return checked.select(
        "ord",
        F.col("s.is_valid").alias("is_valid"),
        F.col("s.reason").alias("validity_reason"),
        round_to(F.col("c"), 4).alias("compactness"),
        round_to(F.col("s.aspect_ratio"), 2).alias("aspect_ratio"),
        ((F.col("c") < SLIVER) | (F.col("s.aspect_ratio") > LONGEST_ASPECT)).alias("is_sliver"),
    )


def area_deviation(text_sqm: Column, gis_sqm: Column) -> Column:
    """Percent difference, two digits; null when there is no usable text area."""
    pct = round_to(F.abs(text_sqm - gis_sqm) / F.greatest(F.lit(1.0), gis_sqm) * 100.0, 2)
    return F.when(text_sqm > 0, pct)


def area_severity(pct: Column, warn: float = WARN_PCT, error: float = ERROR_PCT) -> Column:
    return F.when(pct > error, 2).when(pct > warn, 1).otherwise(0)


def admin_mismatches(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Notes for levels whose names do not contain one another; empty names pass."""
    notes = []
    for level, (doc, gis) in pairs.items():
        d, g = F.lower(doc), F.lower(gis)
        apart = (d != "") & (g != "") & ~g.contains(d) & ~d.contains(g)
        notes.append(
            F.when(apart, F.concat(F.lit(f"{level}_mismatch:doc='"), doc, F.lit("'_gis='"), gis, F.lit("'")))
        )
    return F.array_compact(F.array(*notes))


def cross_check(
    records: DataFrame, parcels: DataFrame, warn: float = WARN_PCT, error: float = ERROR_PCT
) -> DataFrame:
    """Full cadastral check, one row per document: matched, status, deviations, areas, overlaps.

    ``records``: document_id, ulpin, survey_no, sub_division, village, tehsil, district, text_sqm,
    boundaries (map). ``parcels``: the cadastre with ``ord`` and ``ring``.
    """
    shapes = distinct_shapes(parcels)
    counts = overlap_counts(parcels, overlap_pairs(shapes), shapes)
    ring = F.col("ring")
    layer = G.with_measures(parcels).select(
        "ord",
        F.col("ulpin").alias("gis_ulpin"),
        F.col("village").alias("gis_village"),
        F.col("tehsil").alias("gis_tehsil"),
        F.col("district").alias("gis_district"),
        "neighbours",
        G.metric_area(ring).alias("computed_sqm"),
        F.col("area_sqm"),
    ).withColumn("gis_sqm", F.coalesce("area_sqm", "computed_sqm"))
    checked = layer.join(_dealt(shape_checks(parcels)), "ord").join(_dealt(counts.select("ord", "overlaps")), "ord")
    joined = records.join(_dealt(find_parcels(records, parcels)), "document_id", "left").join(_dealt(checked), "ord", "left")
    pct = area_deviation(F.col("text_sqm"), F.col("gis_sqm"))
    admin = admin_mismatches(
        {c: (F.col(c), F.col(f"gis_{c}")) for c in ("village", "tehsil", "district")}
    )
    claims = F.coalesce(
        unmatched_boundaries(F.col("boundaries"), F.col("neighbours")),
        F.array().cast("array<struct<key:string,value:string>>"),
    )
    rated = joined.withColumns({"matched": F.col("ord").isNotNull(), "_pct": pct, "_admin": admin, "_claims": claims})
    area_note = F.when(
        F.col("_pct") > error,
        F.concat(F.lit("critical_area_mismatch:"), F.col("_pct").cast("string"), F.lit(f"%>{error}%")),
    ).when(
        F.col("_pct") > warn,
        F.concat(F.lit("moderate_area_mismatch:"), F.col("_pct").cast("string"), F.lit(f"%>{warn}%")),
    )
    shape_note = F.when(
        ~F.col("is_valid"), F.concat(F.lit("invalid_polygon_geometry:"), F.col("validity_reason"))
    ).when(
        F.col("is_sliver"),
        F.concat(F.lit("sliver_polygon_detected:compactness="), F.col("compactness").cast("string")),
    )
    claim_notes = F.transform(
        F.col("_claims"),
        lambda e: F.concat(e["key"], F.lit("_neighbour_unmatched:doc='"), e["value"], F.lit("'")),
    )
    overlap_note = F.when(
        F.col("overlaps") > 0,
        F.concat(F.lit("cadastral_overlap_detected:"), F.col("overlaps").cast("string"), F.lit("_parcels")),
    )
    deviations = F.concat(
        F.array_compact(F.array(area_note)),
        F.col("_admin"),
        claim_notes,
        F.array_compact(F.array(shape_note, overlap_note)),
    )
    worst = F.greatest(
        area_severity(F.col("_pct"), warn, error),
        F.when(F.size("_admin") > 0, 2).otherwise(0),
        F.when(F.size("_claims") > 0, 1).otherwise(0),
        F.when(~F.col("is_valid"), 2).when(F.col("is_sliver"), 1).otherwise(0),
        F.when(F.col("overlaps") > 0, 2).otherwise(0),
    )
    status = F.when(~F.col("matched"), "error").otherwise(
        F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("error")), worst + 1)
    )
    missing = F.array(F.lit("missing_cadastral_parcel"))
    return rated.select(
        "document_id",
        "matched",
        status.alias("status"),
        F.col("gis_ulpin").alias("ulpin"),
        "tier",
        "gis_sqm",
        "computed_sqm",
        "text_sqm",
        F.coalesce("_pct", F.lit(0.0)).alias("discrepancy_pct"),
        "overlaps",
        F.when(F.col("matched"), deviations).otherwise(missing).alias("deviations"),
    )
