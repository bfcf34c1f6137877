import pytest

#: Null, empty, short, repeated and clashing rows, odd white space, other scripts, control strings.
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "one",
    "two words",
    "it's I'll we've  two  blanks\n\n\nlines \n end ",
    "tab\tand\x0bvertical\x1cseparator\x85next\xa0hard space",
    "naïve Ünïcode ǅ ﬁ ² Ⅷ ٣ 漢字かな 한글 😀👍🏽 é",
    "special <|endoftext|> and <|startoftext|>x<|endoftext|>",
    "numbers 1234 5.678 a1b2 _under_score #*$%&|<>",
    "A" * 5000,
    "ab" * 3000 + " " + "ab" * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, some of them twice, with null and repeated ids and columns named like those that operators add."""
    more = ("i", "t", 5, "s", 0.5, "salt", "g", "r")
    rows = [(i, t, "en", "s", 1, "x", 7, *more) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, ODD_TEXTS[6], None, "s", 1, "x", 7, *more), (3, ODD_TEXTS[6], None, "s", 1, "x", 7, *more)]
    rows += [(None, ODD_TEXTS[8], "en", None, 1, None, None, *more)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, "
        "_id string, _t string, _d int, _spans string, _w double, _salt string, grp string, row string",
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
