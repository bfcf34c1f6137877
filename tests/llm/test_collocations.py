import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from landq.llm import collocations
from landq.llm.collocations import SIDE, Ranks, cell_ids, cell_keys, tallied

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=10):
    """Phrases of (lang, text) by plain counting."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang, *words[i : i + size]] += 1
    found = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *words), a in found.items():
        longer = [b for k, b in found.items() if k[0] == lang and len(k) > len(words) + 1 and (tuple(words) in (k[1:3], k[2:4]))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, *words[:k]], counts[lang, *words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [
        (lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, held in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(held)[:top])
    ]


def corpus():
    rng = np.random.default_rng(4)
    words = np.array(["Of", "the", "a", "é", "ÉE", "new", "york", "times", "x y", "\x1c", "in", "to", "b", "c"])
    rows = []
    for i in range(120):
        tokens = words[np.minimum(rng.zipf(1.3, 60) - 1, len(words) - 1)].tolist()
        text = ""
        for token in tokens:
            text += token + [" ", "  ", "\t", ", ", "\n", " ", " ", " "][rng.integers(8)]
        rows.append(([None, "und", "en", "de"][i % 4], text + "new york times. " * (i % 3)))
    rows += [("en", None), ("en", ""), (None, " \n.,"), ("fr", "one two"), ("en", "z " * 3000), ("en", "z " * 30), ("", "q w " * 40)]
    return rows


@pytest.mark.parametrize("most", [(1 << 18, 1 << 21), (6, 1 << 21), (1 << 18, 5), (4, 3), (1, 1)])
def test_against_brute_force(spark, most):
    rows = corpus()
    frame = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, n int").repartition(4)
    got = collocations.collocations(frame, 2000, *most)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_best_only(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(frame, 7).collect())) == sorted(brute(rows, 7))


def test_small_parts(spark, monkeypatch):
    # many flushes, several deals, sums that are made anew while rows come
    monkeypatch.setattr(collocations, "HELD_PAIRS", 200)
    monkeypatch.setattr(collocations, "HELD_WORDS", 5)
    monkeypatch.setattr(collocations, "DEALT", 50)
    rows = corpus()
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(frame).collect())) == sorted(brute(rows))


def test_tiles():
    rng = np.random.default_rng(1)
    left = np.minimum(rng.zipf(1.2, 900_000), (1 << 21) - 1).astype(np.int64)
    right = np.minimum(rng.zipf(1.2, 900_000), (1 << 18) - 1).astype(np.int64)
    back = cell_ids(cell_keys(left, right))
    assert (back[0] == left).all() and (back[1] == right).all()
    want = Counter(zip(left.tolist(), right.tolist(), strict=True))
    got, tiles = Counter(), set()
    for tile, keys, counts in tallied(left, right):
        assert (np.diff(keys) > 0).all()
        i, j = cell_ids(keys)
        tiles.add(tile)
        if tile >= 0:
            assert set(zip((i // SIDE).tolist(), (j // SIDE).tolist(), strict=True)) == {collocations.CORNER_TILES[tile]}
        got.update(dict(zip(zip(i.tolist(), j.tolist(), strict=True), counts.tolist(), strict=True)))
    assert got == want and {-1, 0} <= tiles


def test_sums_in_parts():
    sums = collocations.Sums(len(collocations.CORNER_TILES) + 3)
    keys = np.arange(0, 900_000, dtype=np.int64) * 7
    for k in range(5):
        sums.add(keys + k % 2, np.ones(len(keys), np.int64))
    total = dict(zip(*(x.tolist() for x in sums.total()), strict=True))
    assert total[0] == 3 and total[1] == 2 and len(total) == 1_800_000


def test_ranks():
    words = pa.table({"lang": ["en", "en", "de"], "word": ["b", "a", "a"]})
    ranks = pickle.loads(pickle.dumps(Ranks(words, (np.array([1, 0]), np.array([0, 0])))))
    ids = ranks.ids("en", b"A b\tb q. a")
    assert ids.tolist() == [1, 0, 0, -3, -1, 1, -1]
    assert ranks.pairs(ids).tolist() == [0, 1, -1, -1, -1, -1]
    assert ranks.ids("it", b"a a").tolist() == [-3, -3, -1]


def test_bitmap(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITMAP_BITS", 17)
    words = [f"word{i}" for i in range(3000)]
    bits = collocations.Bits(spark.createDataFrame([("é", w) for w in words], "lang string, word string"), "lang", "word")
    assert all(bits.has("é".encode(), w.encode()) for w in words)
    assert sum(bits.has("é".encode(), f"other{i}".encode()) for i in range(3000)) < 150
    # all places of a small bitmap, the first and the last one included
    monkeypatch.setattr(collocations, "BITMAP_BITS", 4)
    few = collocations.Bits(spark.createDataFrame([("é", w) for w in words], "lang string, word string"), "lang", "word")
    assert all(few.has("é".encode(), f"other{i}".encode()) for i in range(200))
    one = collocations.Bits(spark.createDataFrame([("é", "word1")], "lang string, word string"), "lang", "word")
    assert one.has("é".encode(), b"word1") and sum(one.has("é".encode(), w.encode()) for w in words) < 400


def test_equal_first_halves(monkeypatch):
    # words whose hashes agree in the first half are told apart by the second
    halves = lambda lang, words: (np.zeros(len(words), np.uint64), np.array([len(w) for w in words], np.uint64))
    monkeypatch.setattr(collocations, "_word_keys", lambda lang, words: halves(lang, list(words)))
    ranks = Ranks(pa.table({"lang": ["en"] * 3, "word": ["aaa", "a", "aa"]}))
    assert ranks.ids("en", b"b bb bbb bbbb").tolist() == [1, 2, 0, -3, -1]


def test_large_counts(spark):
    a, left, right = 9 * 10**12, 10**13 + 7, 9 * 10**12 + 1
    frame = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("l", "r"))
    assert frame.first()[0] == 10**6 * a * a // (left * right)


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, collocations.collocations(odd_docs).collect())) == sorted(brute(rows))
    assert collocations.collocations(no_docs).collect() == []


def test_query(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, collocations.op11_collocations(spark, SF).collect())) == sorted(brute(rows))
