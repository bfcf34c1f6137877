import json

import pytest
from pyspark.sql import functions as F

from landq.operators import confidence, forensics, listing, masking, ownership, records, review
from landq.plans.catalogue import archive_views
from landq.sources import readers, sinks

EVENTS = "event_id int, task_id int, reviewer_id string, role string, action string, is_checker boolean, ts int"
TASKS = "task_id int, document_id int, double_review_required boolean, uncertainty double"


def state(spark, *events):
    tasks = spark.createDataFrame([(1, 10, True, 0.45), (2, 20, False, 0.2)], TASKS)
    accepted, refused = review.split_allowed(spark.createDataFrame(list(events), EVENTS))
    rows = {r.task_id: r for r in review.review_state(tasks, accepted).collect()}
    return rows, refused.count()


def test_maker_then_checker(spark):
    maker = (1, 1, "v1", "verifier", "approved", None, 1)
    rows, _ = state(spark, maker)
    assert (rows[1].status, rows[1].document_status, rows[1].completed_at) == ("maker_reviewed", "maker_reviewed", None)
    assert rows[2].status == "needs_review"
    rows, _ = state(spark, maker, (2, 1, "s1", "officer", "approved", None, 2))
    assert (rows[1].status, rows[1].document_status) == ("verified", "published")
    assert (rows[1].maker_id, rows[1].checker_id, rows[1].overall_confidence) == ("v1", "s1", 0.99)


def test_checker_rejection_is_kept_and_same_person_flagged(spark):
    rows, _ = state(spark, (1, 1, "s1", "admin", "approved", False, 1), (2, 1, "s1", "admin", "rejected", True, 2))
    assert (rows[1].document_status, rows[1].same_person) == ("rejected", True)


def test_who_may_act(spark):
    rows, refused = state(spark, (1, 2, "a", "auditor", "approved", None, 1), (2, 2, "v", "verifier", "approved", True, 2))
    assert refused == 2 and rows[2].status == "needs_review"


def test_corrections_round_trip(spark, tmp_path):
    fields = spark.createDataFrame(
        [(1, "survey_no", "12", "raw 12", 0.5, ["x"]), (2, "survey_no", "12", "raw 12", 0.6, [])],
        "document_id int, field_name string, value string, raw_text string, confidence double, flags array<string>",
    )
    overrides = spark.createDataFrame(
        [(1, 1, "survey_no", "13", "v1", 5), (2, 1, "survey_no", "14", "v2", 6)],
        "event_id int, document_id int, field_name string, new_value string, reviewer_id string, ts int",
    )
    done = {r.document_id: r for r in review.apply_overrides(fields, overrides).collect()}
    assert (done[1].reviewed_value, done[1].confidence, done[1].flags) == ("14", 1.0, ["x", "human_certified_by:v2"])
    assert (done[2].is_reviewed, done[2].confidence) == (False, 0.6)
    log = review.correction_log(overrides, fields)
    memory = review.alias_memory(log)
    assert [(r.preferred_value, r.usage_count) for r in memory.collect()] == [("14", 2)]
    assert [r.suggested_value for r in review.apply_aliases(fields, memory).collect()] == ["14", "14"]
    sinks.write_corrections(log, str(tmp_path / "c"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[0]["messages"][1] == {"role": "user", "content": "Extract field 'survey_no' from raw text: 'raw 12'"}
    assert [x["messages"][2]["content"] for x in lines] == ["13", "14"]


def test_exports_read_back(spark, tmp_path):
    ring = [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 2.0)]
    parcels = spark.createDataFrame(
        [(0, "U1", "7", "Ond", "Satara", ring)],
        "ord long, ulpin string, survey_no string, village string, district string, ring array<struct<x:double,y:double>>",
    )
    docs = spark.createDataFrame([(1, "a.jpg", "t", "published", 0.9, "2020"), (2, "b.jpg", "t", "rejected", 0.1, "2021")], "document_id int, filename string, doc_type string, status string, overall_confidence double, created_at string")
    fields = spark.createDataFrame([(1, "survey_no", "7"), (1, "village", " ond"), (1, "owner_0_name", "Asha Rao")], "document_id int, field_name string, value string")
    rows = listing.export_rows(docs, fields, "readonly_api")
    assert len(rows.columns) == 12
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = {r.document_id: r for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    assert (back["1"].owner_name, back["2"].owner_name) == ("A**a R*o", "Unknown")
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert listing.export_rows(docs, fields, "auditor").filter("document_id = 1").first().owner_name == "Asha Rao"
    sinks.write_geojson_lines(listing.export_geometry(rows, parcels), parcels, str(tmp_path / "geo"))
    feats = {f["properties"]["document_id"]: f for f in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "geo")).collect())}
    assert feats[1]["geometry"] == {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}
    assert feats[2]["geometry"] is None


def test_cadastre_reader(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"ulpin": "U1", "survey_no": "1", "village": "Ond", "district": "Satara", "area_sqm": 5.0, "neighbours": ["2"]}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 4], [1, 2]]]}}
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=1))
    parcels = readers.read_cadastre(spark, str(tmp_path / "p.geojson"))
    assert [r.ord for r in parcels.collect()] == [0, 1]
    assert [tuple(p) for p in parcels.first().ring] == [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 2.0)]
    sinks.write_parcels(parcels, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_binary_ingest(spark, tmp_path):
    for name, body in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"one")):
        (tmp_path / name).write_bytes(body)
    uploads = readers.read_uploads(spark, str(tmp_path))
    fresh, again = listing.ingest(uploads)
    assert (fresh.count(), again.count()) == (2, 1)
    fresh, again = listing.ingest(uploads, fresh)
    assert (fresh.count(), again.count()) == (0, 3)


def test_confidence_parts(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.1, 1.0, 1.0), (0.0, 1.0, 0.0, 0.3, 0.4), (0.1, 0.0, 0.35, 0.0, 0.3)], "o double, a double, d double, f double, c double")
    parts = confidence.breakdown(*[F.col(c) for c in "oadfc"])
    assert [r[0] for r in df.select(parts["final"]).collect()] == [0.76, 0.66, 0.05]


def test_masked_view_depends_on_role(spark):
    fields = spark.createDataFrame([("owner_0_name", "Suresh Patil", "सुरेश पाटील", ["q"])], "field_name string, value string, raw_text string, flags array<string>")
    row = masking.mask_fields(fields, "operator").first()
    assert (row.value, row.flags) == ("S****h P***l", ["q", "pii_masked:restricted_access"])
    assert masking.mask_fields(fields, "Officer").first().value == "Suresh Patil"


def test_missing_root_and_breaks(spark):
    rows = [(1, 1, 0, "M-1", "2001-01-01", None, "B"), (1, 2, 0, "M-2", "2002-01-01", "B", "C"), (1, 3, 0, "M-3", "2003-01-01", "X", "D"), (2, 4, 0, "M-4", None, "A", "B")]
    df = spark.createDataFrame(rows, "parcel_id int, document_id long, idx int, mutation_no string, mutation_date string, from_party string, to_party string")
    assert [r.parcel_id for r in ownership.missing_roots(df).collect()] == [1]
    assert [(r.mutation_no, r.last_holder) for r in ownership.title_breaks(df).collect()] == [("M-3", "C")]


def test_tile_metrics_of_plain_and_striped_tiles(spark):
    plain, stripes = [255] * 256, [0 if (i // 2) % 2 else 200 for i in range(256)]
    df = spark.createDataFrame([(1, 0, 0, 16, 16, plain), (1, 1, 1, 16, 16, stripes)], "page_id int, row int, col int, h int, w int, pixels array<int>")
    got = {r.row: r for r in forensics.tile_metrics(df).collect()}
    assert (got[0].blur, got[0].noise, got[0].contrast, got[0].fade, got[0].tear) == (0.0, 0.0, 0.0, 0.0, 0.35)
    assert got[1].tear == 0.0 and got[1].contrast == 1.0 and got[1].fade == pytest.approx(0.5)
    assert got[1].blur > 1000
    quality = forensics.page_quality(forensics.tile_metrics(df)).first().quality
    assert len(quality.tile_metrics) == 2


def test_rows_without_a_parcel_are_spread(spark):
    """Their empty keys would put them into one task each; a parcel without a survey number is still found by all of its rows."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    ring = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    parcels = spark.createDataFrame(
        [(5, "U5", "7", "Ond"), (3, "U3", "", "Ond"), (4, "", " ", "ond "), (9, None, None, "Ond"), (8, "U8", "8", None)],
        "ord long, ulpin string, survey_no string, village string",
    ).withColumn("ring", ring)
    ids = spark.range(4000).withColumnRenamed("id", "document_id")
    empty = ids.select("document_id", F.when(F.col("document_id") % 2 == 0, "").alias("ulpin"), F.lit("").alias("survey_no"), F.lit("Wai").alias("village"))
    known = spark.createDataFrame(
        [(5000, "U5", "", "Ond"), (5001, "", " 7", "OND"), (5002, None, "", "ond"), (5003, "U8", None, "Ond"), (5004, "=U5", "8", "")],
        "document_id long, ulpin string, survey_no string, village string",
    )
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = listing.export_geometry(empty, parcels)
        counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 4000 and max(counts) < 2000
        lines = sinks.features(rows, parcels)
        counts = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 4000 and max(counts) < 2000
        got = {r.document_id: r.ord for r in listing.export_geometry(known, parcels).collect()}
        assert got == {5000: 3, 5001: 5, 5002: 3, 5003: 8, 5004: None}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_fields_are_dealt_before_they_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(records, "DEALT", 100)
    fields = spark.range(1000).select((F.col("id") % 300).alias("document_id"), F.lit("village").alias("field_name"), F.col("id").cast("string").alias("value"))
    wide = records.widen(fields, ["village"])
    assert wide.rdd.getNumPartitions() == 10
    assert wide.count() == 300 and wide.filter("document_id = 1").first().village == "901"


def test_rows_of_a_document_are_dealt_before_they_are_listed(spark, capsys):
    archive_views.nested_records(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_COL") == 2 and "array_sort" not in plan
