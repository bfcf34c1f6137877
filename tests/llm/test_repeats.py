import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from landq.llm import repeats
from landq.llm.repeats import kept_text, op5_repeats, remove_repeats, removed_runs, with_spans
from landq.llm.suffix_array import common_prefixes, repeated_starts, smaller_than_next, suffix_order

SF = "/root/testdata/sf0.001"


def brute(texts, depth):
    """Removed runs of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + depth] for b in raw for i in range(len(b) - depth + 1))
    out = []
    for b in raw:
        spans = [{"lo": i, "hi": i} for i in range(len(b) - depth + 1) if seen[b[i : i + depth]] > 1]
        out.append(removed_runs(spans, depth))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, [2, 3, 256, 1, 5, 2][seed], [200, 500, 300, 60, 1, 0][seed]).astype(np.uint8)
    raw = text.tobytes()
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert smaller_than_next(text).tolist() == [raw[i:] < raw[i + 1 :] for i in range(len(raw))]
    order = suffix_order(text, 600)
    ends = {i for i in range(len(raw)) if raw[i:].strip(b"\0") == b""}  # zeros at the end count as the end
    assert [i for i in order.tolist() if i not in ends] == [i for i in want if i not in ends]
    common = common_prefixes(text, order, 16)
    for a, b, n in zip(order, order[1:], common, strict=False):
        same = 0
        while same < 16 and max(a, b) + same < len(raw) and raw[a + same] == raw[b + same]:
            same += 1
        assert n >= same // 8 * 8


def test_repeated_starts():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    seen = Counter(s[i : i + 9] for s in strings for i in range(len(s) - 8))
    for s, starts in zip(strings, repeated_starts(strings, 9), strict=True):
        assert starts.tolist() == [i for i in range(len(s) - 8) if seen[s[i : i + 9]] > 1]


def corpus():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé fghij\n") for _ in range(n))
    passage, other = word(500), word(190)
    docs = [word(rng.randint(0, 900)) for _ in range(20)]
    docs += [word(rng.randint(0, 300)) + passage + word(rng.randint(0, 300)) for _ in range(25)]
    docs += [word(50) + passage[i : i + 230] + word(50) for i in range(0, 260, 20)]
    docs += [word(40) + other + word(40) for _ in range(5)]
    docs += ["x" * 1000, "xy" * 700, word(300) * 2, docs[0], docs[0], None, "", passage[:100]]
    return docs


def run(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.row.doc_id: removed_runs(r.spans, 200) for r in with_spans(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_against_brute_force(spark):
    run(spark, corpus())


@pytest.mark.parametrize("very_many", [5, 1000])
def test_small_parts_and_hot_anchors(spark, monkeypatch, very_many):
    # texts longer than a part, anchors with more kinds than go into one block, as pieces and as single windows
    monkeypatch.setattr(repeats, "PART", 700)
    monkeypatch.setattr(repeats, "MANY_KINDS", 4)
    monkeypatch.setattr(repeats, "VERY_MANY_KINDS", very_many)
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    run(spark, corpus())


def test_remove_repeats(spark, odd_docs, no_docs):
    out = remove_repeats(odd_docs)
    assert out.schema == odd_docs.schema
    rows, source = out.collect(), odd_docs.collect()
    assert len(rows) == len(source)
    want = [t and kept_text(t.encode(), r) for t, r in zip([r.text for r in source], brute([r.text for r in source], 200), strict=True)]
    assert Counter(r.text for r in rows) == Counter(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("kind", ["int", "long", "short", "double", "string"])
def test_n_chars_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "x" * 500, "1"), (2, "y", "1"), (3, None, None)], "doc_id int, text string, n string")
    out = remove_repeats(docs.withColumn("n_chars", F.col("n").cast(kind)).drop("n"))
    assert out.schema["n_chars"].dataType.simpleString() == {"long": "bigint", "short": "smallint"}.get(kind, kind)
    assert {r.doc_id: r.n_chars and float(r.n_chars) for r in out.collect()} == {1: 0, 2: 1, 3: None}


def test_characters_stay_whole():
    raw = "aébécé".encode()
    assert kept_text(raw, [(2, 5)]) == "acé"


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    runs = dict(zip(docs, brute(docs.values(), 200), strict=True))
    for r in op5_repeats(spark, SF).collect():
        raw = docs[r.doc_id].encode()
        kept = repeats.kept_bytes(raw, runs[r.doc_id])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(raw) - len(kept), len(runs[r.doc_id]))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
