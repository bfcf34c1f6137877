import random

import pytest
from pyspark.sql import functions as F

from landq.functions import similarity
from landq.operators import confidence, normalize


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def window(a, b):
    short, long = sorted((a, b), key=len)
    m = len(short)
    pieces = [long[max(0, i) : i + m] for i in range(1 - m, len(long))]
    return max(ratio(short, p) for p in pieces if p)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé पाट") for _ in range(n))
    return [(word(rng.randint(1, 12)), word(rng.randint(1, 30))) for _ in range(300)]


def test_ratio_is_the_longest_common_subsequence(pairs):
    got = similarity.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([ratio(a, b) for a, b in pairs])
    assert similarity.ratios(["", "a"], ["", ""]).tolist() == [100.0, 0.0]


def test_best_window_over_all_windows(pairs):
    for a, b in pairs:
        want = max(window(a, b), window(b, a)) if len(a) == len(b) else window(a, b)
        assert similarity.best_window(a, b) == pytest.approx(want), (a, b)


def test_long_patterns_take_the_other_way():
    rng = random.Random(3)
    a = "".join(rng.choice("abc") for _ in range(80))
    b = "".join(rng.choice("abc") for _ in range(150))
    assert similarity.best_window(a, b) == pytest.approx(window(a, b))


def test_agreement_floor_default_and_containment(spark):
    fields = spark.createDataFrame(
        [(1, 1, "a", "Wagholi"), (1, 1, "b", "Wagoli"), (1, 1, "c", "zzzz"), (1, 1, "d", ""), (2, 2, "a", "Pune")],
        "document_id long, page_id long, field_name string, value string",
    )
    texts = spark.createDataFrame([(1, 1, "village WAGHOLI taluka Haveli " * 400)], "document_id long, page_id long, text string")
    got = {(r.document_id, r.field_name): r.agreement for r in confidence.engine_agreement(fields, texts).collect()}
    assert got[(1, "a")] == 1.0
    assert got[(1, "b")] == pytest.approx(round(window("wagoli", "village wagholi taluka haveli village") / 100, 2))
    assert got[(1, "c")] == 0.4
    assert got[(1, "d")] == got[(2, "a")] == 0.95


def test_cross_script_names(spark):
    df = spark.createDataFrame([("Ramesh Patil", "श्री रमेश पाटील"), ("Patil Ramesh", "Ramesh Patil"), ("Anil", "Kiran Desai")], "a string, b string")
    got = [(r.is_match, r.name_score) for r in normalize.match_names(df, "a", "b").orderBy("a").collect()]
    assert sorted(got)[1:] == [(True, 1.0), (True, 1.0)]
    assert sorted(got)[0][0] is False


def test_land_classes(spark):
    raw = ["बागायत", "जिरायत", "बिगरशेती", "unirrigated", "असिंचित", "  Banjar ", "reserved forst", "na", "moon", "", None]
    want = ["irrigated", "unirrigated_dry", "non_agricultural", "unirrigated_dry", "unirrigated_dry", "barren_waste", "forest_government", "non_agricultural", "moon", "unspecified", "unspecified"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = normalize.normalize_land_class(df, "raw", "i").orderBy("i").collect()
    assert [r.land_class for r in got] == want
    assert got[0].class_flag == "normalized_land_class:बागायत->irrigated"
    assert got[9].class_flag == "empty_land_class"


def test_labels(spark):
    raw = ["गट क्रमांक", "खसरा संख्या", "खातेदार क्रमांक", "Survey No.", "survay number", "colour"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = [(r.canonical_name, r.label_confidence) for r in normalize.canonicalize_labels(df, "raw", "i").orderBy("i").collect()]
    assert got[:4] == [("survey_or_khasra_no", 1.0)] * 2 + [("khata_no", 1.0), ("survey_or_khasra_no", 1.0)]
    assert got[4][0] == "survey_or_khasra_no" and 0.8 <= got[4][1] < 1
    assert got[5] == ("colour", 0.5)


def test_areas(spark):
    rows = [(0, 10.0, "guntha", "Maharashtra"), (1, 2.0, "bigha", "Uttar Pradesh"), (2, 2.0, "bigha", None), (3, 5.0, "chain", "UP"), (4, 0.0, "acre", "UP")]
    df = spark.createDataFrame(rows, "i int, value double, unit string, state string")
    got = normalize.convert_area(df, "value", "unit", "state").orderBy("i").collect()
    assert (got[0].area_sqm, got[0].area_hectares) == (pytest.approx(1011.7141), pytest.approx(0.101171))
    assert got[1].area_sqm == pytest.approx(5058.5705)
    assert got[2].area_flags == ["warning:state_context_required_for_bigha:range=[1600.0,5058.57]sqm"]
    assert (got[3].area_sqm, got[3].area_flags) == (5.0, ["unmapped_area_unit:chain"])
    assert (got[4].area_sqm, got[4].area_flags) == (None, ["invalid_or_zero_area"])
