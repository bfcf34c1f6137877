import datetime

import pytest
from pyspark.sql import functions as F

from landq.functions import text




def test_digits_of_three_scripts(values):
    got = values(text.indic_to_ascii, "१०३/२", "४०५०", "૧૦૧/૪", "౧౦౨", None)
    assert got == ["103/2", "4050", "101/4", "102", ""]


def test_dates(values):
    day = datetime.date(2021, 9, 5)
    forms = ["2021-09-05", "05-09-2021", "5/9/2021", "2021/9/5", " 05.09.2021 ", "2021.09.05"]
    assert values(text.parse_date, *forms) == [day] * 6
    bad = ["2021-09/05", "05-09-21", "2021-13-01", "2021", "2021-09", "30-02-2021", "=2021-09-05", "", None]
    assert values(text.parse_date, *bad) == [None] * len(bad)


def test_shares(values):
    forms = {"1/2": 0.5, "50%": 0.5, "0.25": 0.25, " 25 %": 0.25, "1": 1.0}
    forms |= {"abc": 0, "1/0": 0, "1/2/3": 0, "": 0, "1d": 0, "NaN": 0}
    assert values(text.parse_share, *forms) == [pytest.approx(v) for v in forms.values()]


def test_numbers_are_plain(values):
    good = {"12": 12.0, "-1.5": -1.5, " 7 ": 7.0, "1e3": 1000.0, ".5": 0.5}
    assert values(text.to_number, *good) == list(good.values())
    assert values(text.to_number, "1d", "2F", "Infinity", "nan", "0x1p3", "x", "", None) == [None] * 8


def test_masks(values):
    names = ["Ramesh", "Ramesh Kumar", "Anand", "A", None, "Jo Li"]
    assert values(text.mask_name, *names) == ["R****h", "R****h K***r", "A***d", "****", "****", "J* L*"]
    ids = ["1234 5678 9012", "123456789012", "9876543210", "ABCDE1234F", "A12345", "x1"]
    want = ["XXXX-XXXX-9012", "XXXX-XXXX-9012", "XXXXXX3210", "XXXXXX234F", "**2345", "****"]
    assert values(text.mask_id, *ids) == want


def test_names(values):
    assert values(text.strip_honorifics, "श्री रमेश बापूराव पाटील", "Shri. Ramesh Patil", "कु. किरण") == [
        "रमेश बापूराव पाटील",
        "Ramesh Patil",
        "किरण",
    ]
    assert values(text.transliterate, "श्री रमेश पाटील", "रमेश  Kale") == ["Ramesh Patil", "Ramesh Kale"]


def test_document_types(values):
    kind = text.document_type
    got = values(kind, "Form SATBARA extract", "फेरफार नोंद", "Sale Deed 12", "village map sheet", "letter", None)
    assert [(r.doc_type, r.confidence) for r in got] == [
        ("khatauni_7_12", 0.94),
        ("mutation_register", 0.92),
        ("sale_deed", 0.93),
        ("cadastre_map", 0.95),
        ("khatauni_7_12", 0.70),
        ("khatauni_7_12", 0.70),
    ]


def test_only_personal_fields_are_masked(spark):
    rows = [("owner_name", "Suresh Patil"), ("ownership_type", "freehold"), ("owner_0_share", "0.5"), ("survey_no", "142/1"), ("aadhaar_number", "999988887777")]
    df = spark.createDataFrame(rows, "n string, v string")
    got = {r[0]: r[1] for r in df.select("n", text.mask_field(F.col("n"), F.col("v"))).collect()}
    assert got == {
        "owner_name": "S****h P***l",
        "ownership_type": "freehold",
        "owner_0_share": "0.5",
        "survey_no": "142/1",
        "aadhaar_number": "XXXX-XXXX-7777",
    }


def test_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.25,), (0.5,)], "v double")
    assert [r[0] for r in df.select(text.round_to(F.col("v"), 2)).collect()] == [1.0, 2.68, -1.25, 0.5]
