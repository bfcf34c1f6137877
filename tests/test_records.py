"""Record documents end to end: one clean record and single-fault variants of it."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from landq.operators import records as rec
from landq.operators import rules
from landq.plans import archive
from landq.schemas import RECORD
from landq.sources import readers, sinks
from landq.sources import rulebook as rb
from landq.sources.rulebook import RuleBook

AS_OF = "2026-01-01"


def item(value, confidence=0.95, bbox=(0.1, 0.1, 0.2, 0.9)):
    text = value if isinstance(value, str) else json.dumps(value)
    return {"value": value, "raw_text": text, "confidence": confidence, "bbox": list(bbox), "source_engine": "test", "flags": [], "confidence_breakdown": None}


def owner(name, share, deceased=False, father="B. Patil", minor=False):
    return {"name": item(name), "father_or_husband_name": item(father) if father else None, "share": item(share), "is_minor": item(minor), "is_deceased": item(deceased)}


def clean():
    return {
        "document_type": item("mutation_register"), "state": item("Maharashtra"), "district": item("Pune"),
        "tehsil": item("Haveli"), "village": item("Wagholi"), "survey_no": item("१०१"), "khata_no": item("53"),
        "sub_division": item("1"), "ulpin": item("27HA1001000101"),
        "plot_area": {"value": item(40.0), "unit": item("guntha"), "area_sqm": item(4046.86), "area_hectares": item(0.4047)},
        "land_classification": item("बागायत"), "ownership_type": item("freehold"),
        "landowners": [owner("Ramesh Patil", 0.5), owner("Suresh Deshmukh", "1/2")],
        "mutation_entries": [
            {"mutation_no": item("M-801"), "mutation_date": item("15-09-2021"), "registration_date": item("2021-05-10"),
             "from_party": item("Shri Ramesh Patil"), "to_party": item("Suresh Deshmukh"), "transferred_area": item(2000.0)}
        ],
        "registration": {"reg_no": item("REG-1"), "reg_date": item("2021-05-10")},
    }


def faulty(change):
    record = clean()
    change(record)
    return record


def set_shares(r):
    r["landowners"] = [owner("A B", 0.4), owner("C D", 0.4)]


def set_value(*path):
    *steps, value = path

    def change(r):
        for step in steps[:-1]:
            r = r[step]
        r[steps[-1]] = item(value)

    return change


FAULTS = {
    rb.SHARES: set_shares,
    rb.HOLDING: set_value("mutation_entries", 0, "transferred_area", 8000.0),
    rb.CHRONOLOGY: set_value("mutation_entries", 0, "mutation_date", "2020-01-10"),
    rb.CAPACITY: set_value("landowners", 0, "is_deceased", True),
    rb.CONVERSION: set_value("land_classification", "commercial"),
    rb.TENURE: set_value("ownership_type", "tribal_restricted"),
    rb.IDENTIFIER: set_value("ulpin", "27HA1001000101999"),
    rb.HIERARCHY: set_value("village", "Atlantis"),
    rb.CEILING: set_value("plot_area", "value", 4000.0),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The clean record, one record per fault, and two records that share a registration number."""
    path = tmp_path_factory.mktemp("records")
    cases = {"clean": clean()} | {rule: faulty(change) for rule, change in FAULTS.items()}
    for i, (name, record) in enumerate(cases.items()):
        record["registration"]["reg_no"] = item(f"DEED-{i}")
        cases[name] = record
    cases["twin_a"], cases["twin_b"] = copy.deepcopy(clean()), copy.deepcopy(clean())
    for name, record in cases.items():
        body = {"image_hash": name, "extraction": record, "agreements": {"survey_no": 0.5, "village": 0.99}}
        (path / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False, indent=1))
    return str(path)


@pytest.fixture(scope="module")
def records(spark, folder):
    return readers.read_records(spark, folder).cache()


@pytest.fixture(scope="module")
def results(spark, records):
    scalars = archive.normalized_records(records)
    return rules.validate(scalars, rec.owner_rows(records), rec.mutation_rows(records), RuleBook.default(), AS_OF).cache()


def failed(results):
    out: dict[str, set[str]] = {}
    for r in results.filter("status = 'failed'").collect():
        out.setdefault(r.document_id, set()).add(r.rule_id)
    return out


def test_single_faults_are_found_and_nothing_else(results):
    got = failed(results)
    assert "clean" not in got
    for rule in FAULTS:
        want = {rule}
        if rule == rb.CEILING:
            assert rule in got[rule]
        else:
            assert got[rule] == want, rule
    assert got["twin_a"] == got["twin_b"] == {rb.DUPLICATE}


def test_messages_and_evidence(results):
    rows = {(r.document_id, r.rule_id): r for r in results.collect()}
    share = rows[(rb.SHARES, rb.SHARES)]
    assert share.message == "Shares add up to 0.8000 instead of 1, off by 0.2000 over 2 owner rows."
    assert (share.severity, share.disclaimer) == ("critical", "advisory, not legal advice")
    over = rows[(rb.HOLDING, rb.HOLDING)]
    assert over.evidence["mutation_index"] == "0" and over.message.startswith("A mutation moves 8000.00 out of")
    twin = rows[("twin_a", rb.DUPLICATE)]
    assert twin.evidence["conflicting_doc_id"] == "twin_b"
    assert rows[("clean", rb.HIERARCHY)].status == "passed"
    assert "in tehsil 'Haveli'" in rows[(rb.HIERARCHY, rb.HIERARCHY)].message


def test_summary_scores(records, results):
    got = {r.document_id: r for r in rules.summarize(records, results).collect()}
    assert (got["clean"].evaluated, got["clean"].score, got["clean"].failed_rules) == (2, 1.0, [])
    assert (got[rb.TENURE].score, got[rb.TENURE].failed_rules) == (0.667, [rb.TENURE])


def test_disabled_and_tuned_rules(records):
    scalars = archive.normalized_records(records)
    book = RuleBook.default().tuned(rb.TENURE, enabled=False).tuned(rb.SHARES, tolerance=0.3)
    got = failed(rules.validate(scalars, rec.owner_rows(records), rec.mutation_rows(records), book, AS_OF))
    assert rb.TENURE not in got and rb.SHARES not in got


def test_rule_book_from_table(spark):
    changes = spark.createDataFrame(
        [(rb.SHARES, 1, 1, None, 0.2), (rb.SHARES, 2, 2, False, None), (rb.TENURE, 1, 3, False, None), (rb.TENURE, 5, 4, True, None)],
        "rule_id string, ts int, id int, enabled boolean, tolerance double",
    )
    book = RuleBook.from_table(rb.apply_overrides(rb.rules_table(spark), changes))
    assert not book.enabled(rb.SHARES) and book.tolerance(rb.SHARES, 9) == 0.2
    assert book.enabled(rb.TENURE) and len(book.rules) == 10
    assert rb.override_audit(changes).count() == 4


def test_flattened_names(records):
    names = {r.field_name for r in rec.flatten_fields(records.filter("document_id = 'clean'")).collect()}
    assert {"survey_no", "plot_area_value", "owner_0_name", "owner_1_share", "mutation_0_area", "reg_no", "owner_0_father_husband"} <= names
    assert "khasra_no" not in names and "plot_area_sqm" not in names


def test_normalized_record(records):
    row = archive.normalized_records(records).filter("document_id = 'clean'").first()
    assert (row.survey_no, row.land_class) == ("101", "irrigated")
    assert row.holding_sqm == pytest.approx(4046.8564)


def test_whole_archive(spark, records):
    quality = "struct<blur_score:double,fade_score:double,stain_coverage:double,tile_metrics:array<struct<bbox:array<double>,blur:double,fade:double,stain:double,tear:double>>>"
    ids = [r.document_id for r in records.select("document_id").collect()]
    pages = spark.createDataFrame(
        [(d, f"{d}-1", (200.0, 0.0, 0.0, [([0.0, 0.0, 1.0, 1.0], 200.0, 0.0, 0.0, 0.0)])) for d in ids],
        f"document_id string, page_id string, quality {quality}",
    )
    ring = [(73.978, 18.579), (73.979, 18.579), (73.979, 18.58), (73.978, 18.58), (73.978, 18.579)]
    parcels = spark.createDataFrame(
        [(0, "27HA1001000101", "101", "Wagholi", "Haveli", "Pune", 4046.86, ["102"], ring)],
        "ord long, ulpin string, survey_no string, village string, tehsil string, district string, area_sqm double, neighbours array<string>, ring array<struct<x:double,y:double>>",
    )
    out = archive.process(records, pages, parcels, [], RuleBook.default(), AS_OF)
    docs = {r.document_id: r for r in out.documents.collect()}
    assert len(docs) == len(ids)
    assert docs["clean"].status == "field_review"  # the stated agreement of .5 pulls one field down
    assert docs[rb.SHARES].status == "document_review"
    geo = {r.document_id: r for r in out.geo.collect()}
    assert geo["clean"].status == "pass" and geo[rb.HIERARCHY].tier == 1
    risk = {r.document_id: r.tamper_risk_level for r in out.risk.collect()}
    assert (risk["clean"], risk["twin_a"], risk[rb.CHRONOLOGY]) == ("low", "medium", "medium")
    tasks = {r.document_id: r for r in out.tasks.collect()}
    assert tasks["clean"].priority == "medium" and tasks["clean"].reasons == 1
    assert out.summary.count() == len(ids)
    named = out.fields.filter("document_id = 'clean' and field_name rlike '^owner_[0-9]+_name$'").collect()
    assert named and all(any(f.startswith("canonical_latin_name:") for f in r.flags) for r in named)


def test_fields_are_normalized_before_they_are_scored(spark, folder):
    raw = readers.read_records(spark, folder).filter("document_id = 'clean'")
    item = lambda path, text: F.col(path).withField("value", F.lit(text))
    regional = raw.withColumn(
        "extraction",
        F.col("extraction")
        .withField("survey_no", item("extraction.survey_no", "१४२/३"))
        .withField("land_classification", item("extraction.land_classification", " Irrigated ")),
    )
    fields = archive.normalized_fields(regional, archive.normalized_records(regional))
    values = {r.field_name: r.value for r in fields.collect()}
    assert values["survey_no"] == "142/3" and values["land_classification"] == "irrigated"


def test_stage_writes_can_be_repeated(spark, results, tmp_path):
    path = str(tmp_path / "results")
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        sinks.write_stage(results, path, day)
    back = spark.read.parquet(path)
    assert back.count() == 2 * results.count()
    assert back.filter(F.col("batch_date") == "2026-01-02").count() == results.count()


def test_schema_is_explicit(spark, folder):
    assert readers.read_records(spark, folder).schema["extraction"].dataType == RECORD["extraction"].dataType


def test_results_make_only_what_is_asked_for(spark):
    """Messages and evidence of a rule are not put together for queries that count its results."""
    owners = spark.createDataFrame([("d", "1/2")], "document_id string, share string")
    records = spark.createDataFrame([("d", "na", "", "x", "tribal", "")], "document_id string, land_class string, na_order_ref string, ulpin string, ownership_type string, tenure_perm_ref string")
    book = RuleBook.default()
    alone = rules._results(records, rules._conversion(book), rules._tenure(book), rules._identifier(book))
    for results in (rules.share_sum(owners, book), alone):
        asked = results.select("document_id", "rule_id", "status")
        plan = asked._jdf.queryExecution().optimizedPlan().toString()
        assert "format_string" not in plan and "map(" not in plan
        assert asked.collect() == results.drop("rule_name", "severity", "message", "evidence", "disclaimer").collect()
    assert sorted(r.message for r in alone.collect()) == [
        "Land class 'na' needs a conversion order and the record names none.",
        "Land id 'x' is not 14 capital letters and digits.",
        "Tenure 'tribal' passes on with permission only and the record names none.",
    ]


def test_deed_dates_of_mutation_and_document(spark):
    records = spark.createDataFrame([("d", "2020-01-05"), ("e", "bad")], "document_id string, reg_date string")
    moves = [("d", 0, "2020-02-01"), ("d", 1, ""), ("d", 2, None), ("d", 3, "bad"), ("e", 0, "1.2.2021"), ("e", 1, ""), ("f", 0, None)]
    moves = spark.createDataFrame([(d, i, "2020-03-01", g) for d, i, g in moves], "document_id string, idx int, mutation_date string, registration_date string")
    got = {(r.document_id, r.idx): (r.deed_text, str(r.deeded_on)) for r in rules.dated_mutations(records, moves).collect()}
    assert got == {
        ("d", 0): ("2020-02-01", "2020-02-01"), ("d", 1): ("2020-01-05", "2020-01-05"), ("d", 2): ("2020-01-05", "2020-01-05"),
        ("d", 3): ("bad", "None"), ("e", 0): ("1.2.2021", "2021-02-01"), ("e", 1): ("bad", "None"), ("f", 0): (None, "None"),
    }


def test_documents_are_met_without_sorting(spark):
    """What meets documents by id or number may be many rows to a task; it is not sorted for that."""
    records = spark.createDataFrame(
        [("d", 10.0, "r", "2020-01-05", "sale_deed"), ("e", 10.0, "r", "2020-01-05", "other")],
        "document_id string, holding_sqm double, reg_no string, reg_date string, document_type string",
    )
    moves = [("d", 0, 20.0, "2020-01-01", ""), ("e", 0, 5.0, "2020-02-01", "")]
    moves = spark.createDataFrame(moves, "document_id string, idx int, transferred_area double, mutation_date string, registration_date string")
    book = RuleBook(RuleBook.default().rules, enforce_scope=True)
    reused = rules.duplicate_registry(records, book)
    met = [rules.dated_mutations(records, moves), rules.area_excess(records, moves, book), reused, rules.in_scope(reused, records, book)]
    for df in met:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert [df.count() for df in met] == [2, 1, 2, 2 if "all" in book.rules[rb.DUPLICATE].applies_to else 1]


def test_hints_leave_other_rules_out(spark):
    from landq.operators import forensics
    from landq.plans.catalogue import CATALOGUE

    book = RuleBook.default().tuned(rb.DUPLICATE, enabled=False).only(*forensics.HINT_RULES)
    assert [r for r in book.rules if book.enabled(r)] == [rb.CHRONOLOGY]
    plan = CATALOGUE["f5_text_logic_hints"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "is_deceased" not in plan and "tenure_perm_ref" not in plan
    found = [("d", rb.DUPLICATE), ("d", rb.CHRONOLOGY), ("d", rb.CHRONOLOGY), ("e", rb.CHRONOLOGY), ("f", rb.SHARES)]
    results = spark.createDataFrame([(d, r, "failed") for d, r in found] + [("g", rb.DUPLICATE, "passed")], "document_id string, rule_id string, status string")
    flags = forensics.text_logic_flags(results)
    assert sorted((r.document_id, r.flag_type, r.severity, r.score) for r in flags.collect()) == [
        ("d", "text_logic_anachronistic_dates", "warn", 0.9), ("d", "text_logic_duplicate_registration", "critical", 0.98),
        ("e", "text_logic_anachronistic_dates", "warn", 0.9),
    ]
