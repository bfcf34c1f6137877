"""Links between names against a comparison of every two."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landq.functions.likeness import Meeting
from landq.functions.similarity import Texts, indel_ratio, ratios
from landq.operators import name_pairs
from landq.plans.catalogue import CATALOGUE

SF = "/root/testdata/sf0.001"


def brute(classes, cutoff):
    names = sorted({c for c in classes if c})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    scores = ratios([a for a, _ in pairs], [b for _, b in pairs]) if pairs else []
    return {(a, b): int(s + 0.5) / 100 for (a, b), s in zip(pairs, scores, strict=True) if s >= cutoff}


def made_names():
    rng = random.Random(8)
    words = ["ram", "rama", "suresh", "suresha", "kumar", "kumari", "patil", "patel", "joshi", "a", "b", "ab", "li", "é", "zq", "😀x"]
    names = [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(150)]
    for name in names[:80]:
        letters = list(name)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z", "u"])
        names.append(" ".join("".join(letters).split()))
    return [*names, "", None, "a", "b", "ab", "ba", "abc", "abd", "abcd", "abce", "aaaa", "aaab", "aaaaaaa", "x" * 40, "x" * 30, "xy" * 20]


@pytest.mark.parametrize("cutoff", [75, 60, 90, 50])
def test_links_against_brute_force(spark, cutoff):
    names = made_names()
    frame = spark.createDataFrame([(n,) for n in names], "class string").repartition(3)
    got = {(r.a, r.b): r.name_score for r in name_pairs.class_links(frame, cutoff).collect()}
    want = brute(names, cutoff)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 0.011 for p in want)


def test_common_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(name_pairs, "PART", 5)
    monkeypatch.setattr(name_pairs, "RANKED", 4)
    names = made_names()
    frame = spark.createDataFrame([(n,) for n in names], "class string")
    assert {(r.a, r.b) for r in name_pairs.class_links(frame).collect()} == brute(names, 75).keys()


def test_few_pairs_are_compared(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(600)]
    texts = name_pairs.described(spark.createDataFrame([(n,) for n in names], "class string"))
    assert name_pairs.candidates(texts, 75).count() < 600 * 599 / 2 / 4


def test_no_row_for_a_pair_is_shuffled(spark, monkeypatch):
    """Texts of the same letters all pass for candidates; shuffles hold each one once for each block that it meets."""
    monkeypatch.setattr(name_pairs, "PART", 100)
    rng = random.Random(2)
    names = ["".join(rng.sample("abcdefghijklmnop", 16)) for _ in range(400)]
    frame = spark.createDataFrame([(n,) for n in names], "class string")
    texts = name_pairs.described(frame)
    assert name_pairs.candidates(texts, 75).count() == 400 * 399 / 2
    assert name_pairs._met(texts, 75).count() == 400 * 4
    assert {(r.a, r.b) for r in name_pairs.class_links(frame).collect()} == brute(names, 75).keys()


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(name_pairs, "PART", 20)
    monkeypatch.setattr(name_pairs, "LONGEST", 90)
    rng = random.Random(3)
    names = ["".join(rng.choice("abéz ") for _ in range(rng.randint(50, 140))).strip() for _ in range(120)]
    frame = spark.createDataFrame([(n,) for n in names], "class string")
    assert {(r.a, r.b) for r in name_pairs.class_links(frame, 70).collect()} == brute(names, 70).keys()


def test_only_distinct_names_are_spelled(spark):
    names = spark.range(1000).selectExpr("concat('Ram ', id % 3) name")
    classes = name_pairs.name_classes(names, "name").select("class").distinct()
    plan = classes._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Relation" in plan
    assert {r["class"] for r in classes.collect()} == {"0 ram", "1 ram", "2 ram"}


def test_no_names(spark):
    assert name_pairs.class_links(spark.createDataFrame([], "class string")).count() == 0
    with pytest.raises(ValueError):
        name_pairs.class_links(spark.createDataFrame([], "class string"), 74.5)


def test_title_links_by_brute_force(spark):
    """p13_title_links has no SQL: comparing every two titles is too slow there."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    titles = [" ".join(sorted((r.text or "").lower().split()[:3])) for r in rows]
    got = {(r.a, r.b) for r in CATALOGUE["p13_title_links"].run(spark, SF).collect()}
    assert got == brute(titles, 75).keys() and got


def test_after_the_ratio_was_used(spark):
    """Functions travel by value: one that names the module of the ratio took its UDF along, which can't travel once it was used."""
    frame = spark.createDataFrame([("abcd",), ("abce",)], "class string")
    assert frame.select(indel_ratio(F.col("class"), F.lit("abcd")).alias("r")).agg(F.max("r")).first()[0] == 100.0
    assert [tuple(r) for r in name_pairs.class_links(frame).collect()] == [("abcd", "abce", 0.75)]


def test_blocks_without_texts(spark, monkeypatch):
    """Texts are dealt by hash, so that some blocks get none; those that meet such a block are not linked among themselves again."""
    monkeypatch.setattr(name_pairs, "PART", 2)
    names = ["abcdefgh" + a + b for a in "ijklm" for b in "nopqrstuvw"]
    rows = name_pairs.class_links(spark.createDataFrame([(n,) for n in names], "class string")).collect()
    assert len(rows) == 50 * 49 / 2 and {(r.a, r.b) for r in rows} == brute(names, 75).keys()


@pytest.mark.parametrize("cutoff", [40, 60, 75, 95])
@pytest.mark.parametrize("lengths", [(1, 9), (20, 34), (30, 63), (55, 80), (120, 300)])
def test_blocks_in_memory_against_brute_force(cutoff, lengths):
    """Texts of one to three words of bits, with and without halves, that are few changes of each other or none."""
    rng = random.Random(f"{cutoff} {lengths}")
    names = set()
    while len(names) < 90:
        name = [rng.choice("abcdeeeé ñ中😀" + "abcdefghijklmnopqrstuvwxyz" * (lengths[0] % 2)) for _ in range(rng.randint(*lengths))]
        for _ in range(3):
            names.add("".join(name))
            for _ in range(len(name) // 5 + 1):
                name[rng.randrange(len(name))] = rng.choice("abcde ")
    names = np.array(sorted(names), dtype=object)
    places = np.arange(len(names))
    for bits in (58, 3):
        for shorts, longs in ((places[::2], places[1::2]), (places[1::2], places[::2]), (places, None)):
            found = [(names[a], names[b]) for i, j, _ in Meeting(names, shorts, longs, cutoff, bits).links() for a, b in zip(i, j)]
            linked = {tuple(sorted(p)) for p in found}
            assert len(linked) == len(found)
            side = set(names[shorts])
            assert linked == {p for p in brute(names, cutoff) if longs is None or (p[0] in side) != (p[1] in side)}


def test_texts_in_another_order_are_not_compared():
    """The same letters in other orders have all in common; before, each two of them were compared in full."""
    rng = random.Random(4)
    names = np.array(["".join(rng.sample("abcdefghijklmnopqr", 18)) for _ in range(300)], dtype=object)
    meeting = Meeting(names, np.arange(300), None, 75, 58)
    assert sum(len(a) for a, _ in meeting.candidates()) == 300 * 299 / 2
    assert sum(len(i) for i, _, _ in meeting._in_order()) < 300 * 299 / 2 / 2


def test_comparisons_that_are_left_have_too_few_characters_in_common():
    names = np.array(["abcdefgh", "abcdxxxx", "xxxxxxxx", "abcdefghabcdefghabcdefghabcdefghabcdefgh", "a", ""], dtype=object)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    want = ratios(names[left].tolist(), names[right].tolist())
    texts = Texts(names)
    total = texts.length[left] + texts.length[right]
    assert np.allclose(texts.ratios(left, right), want)
    for least in range(9):
        got = texts.ratios(left, right, np.full(len(left), least))
        able = want * total >= 200 * least
        assert np.allclose(got[able], want[able]) and (got[~able] * total[~able] < 200 * least).all()


def test_blocks_of_long_texts_are_smaller():
    listed, blocks = name_pairs._blocks([(18, 1_000_000), (1000, 300_000)], 75)
    parts = {length: parts for length, _, parts, _, _ in listed}
    assert sum(parts.values()) == blocks
    assert 1_000_000 / parts[18] <= 64_000 and 300_000 / parts[1000] * 1000 <= name_pairs.LETTERS
