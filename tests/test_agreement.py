"""Values of a page against its text, and names inside names, compared with plain loops."""

import random

import pytest
from test_settings_and_streams import slow_partial

from landq.functions.similarity import contained
from landq.operators import confidence, geo


def want(value, text):
    value, text = (value or "").lower(), (text or "").lower()
    if not value or not text:
        return 0.95
    return 1.0 if value in text else int(max(0.4, slow_partial(value, text) / 100) * 100 + 0.5) / 100


@pytest.mark.parametrize("page_values", [1000, 5])
def test_many_values_of_a_page(spark, page_values):
    rng = random.Random(4)
    text = "".join(rng.choice("abc é\n") for _ in range(120))
    pages = {(1, 1): text, (1, 2): "", (2, 1): None, (3, 1): "Short Text", (4, 1): "x"}
    rows = []
    for d, p in [*pages, (9, 9)]:
        rows += [(d, p, v, "tag") for v in ("", None, "short", "SHORT TEXT and more", "x", text[5:20], *("".join(rng.choice("abcd ") for _ in range(6)) for _ in range(12)))]
    rows += rows[:10]
    fields = spark.createDataFrame(rows, "document_id int, page_id int, value string, _text string").repartition(3)
    texts = spark.createDataFrame([(*k, t) for k, t in pages.items()], "document_id int, page_id int, text string")
    got = confidence.engine_agreement(fields, texts, page_values)
    assert got.columns == [*fields.columns, "agreement"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.agreement - want(r.value, pages.get((r.document_id, r.page_id)))) < 1e-9, r


def test_one_pass_equals_many():
    rng = random.Random(2)
    text = "".join(rng.choice("ab ") for _ in range(200))
    values = list({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    assert contained(values, text) == {v for v in values if v in text} and 0 < len(contained(values, text)) < len(values)


def test_names_inside_names(spark):
    rng = random.Random(6)
    make = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(0, 7)))
    asked, known = [make() for _ in range(120)], [make() for _ in range(120)]
    left = spark.createDataFrame([(v,) for v in [*asked, "wagholi", None]], "a string")
    right = spark.createDataFrame([(v,) for v in [*known, "wagholi khurd", "x", None]], "b string")
    got = {tuple(r) for r in geo.contained_names(left, right, "a", "b").collect()}
    pairs = {(a, b) for a in {*asked, "wagholi"} for b in {*known, "wagholi khurd", "x"} if a and b and (a in b or b in a)}
    assert got == pairs
