import hashlib
from collections import Counter

import numpy as np
import pytest

from landq.llm import lines
from landq.llm.lines import drop_shared_lines, kept_lines, line_hashes, op13_shared_lines, twice_seen

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=40, least_docs=5):
    """(doc_id, kept text, n_lines, n_dropped) of (doc_id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    keeper = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc_id, text in rows:
        held = (text or "").split("\n")
        kept = [line for line in held if key(line) not in keeper or keeper[key(line)] == doc_id]
        out.append((doc_id, "\n".join(kept) if text is not None else None, len(held), len(held) - len(kept)))
    return out


def corpus():
    shared = "Share This line with all your friends, today"
    edge = "é" * 39 + "Ab"
    rows = []
    for i in range(40):
        own = [f"own line {i} of some length, so that it is long enough", shared if i % 2 else " \t" + shared.lower() + "\x0b ", "short"]
        if i < 6:
            own += [edge[1:], edge[2:], "É" * 39 + "x"]
        if i < 4:
            own.append("a line that only four documents hold, and no more")
        if i % 7 == 0:
            own += [shared, "", shared]
        rows.append((i, "\n".join(own)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, shared), (None, shared + "\nand more"), (39, rows[39][1]), (39, shared)]
    return rows


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", 1, "r") for i, t in rows], "doc_id long, text string, drops string, n_lines int, row string").repartition(parts)


def check(spark, rows):
    got = [(r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in kept_lines(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_against_brute_force(spark):
    check(spark, corpus())


def test_full_filters_lose_nothing(spark, monkeypatch):
    # everything is suspected, in several segments, or the filter has next to no room
    monkeypatch.setattr(lines, "SEGMENT_LINES", 16)
    monkeypatch.setattr(lines, "PLACE_BITS", 6)
    monkeypatch.setattr(lines, "FLUSH_HASHES", 10)
    check(spark, corpus())
    docs = frame(spark, corpus())
    assert twice_seen(line_hashes(docs), 4).folded_bits == 3


def test_filters(spark):
    rows = [(i, "\n".join(f"line number {i} {j} " + "x" * 40 for j in range(200)) + "\n" + "y" * 50) for i in range(20)]
    suspects = twice_seen(line_hashes(frame(spark, rows)))
    import xxhash

    once = np.array([xxhash.xxh3_64_intdigest(f"line number {i} {j} ".encode() + b"x" * 40) for i in range(20) for j in range(200)], np.uint64)
    assert suspects.has(np.array([xxhash.xxh3_64_intdigest(b"y" * 50)], np.uint64)).all()
    assert suspects.has(once).mean() < 0.01


@pytest.mark.parametrize("least", [(1, 1), (3, 2)])
def test_other_bounds(spark, least):
    rows = [(i, "a b\nab\nabc\n" + "q" * (i % 3)) for i in range(9)]
    got = [(r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in kept_lines(frame(spark, rows), *least).collect()]
    assert Counter(got) == Counter(brute(rows, *least))


def test_columns_stay(spark, odd_docs, no_docs):
    out = drop_shared_lines(odd_docs)
    assert out.columns == odd_docs.columns
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, t) for d, t, _, _ in want)
    assert drop_shared_lines(no_docs).count() == 0


def test_long_text(spark):
    line = "the same line in a very long document, again and again"
    rows = [(1, "\n".join([line] * 30_000)), *[(i, line + "\nmine") for i in range(2, 7)]]
    check(spark, rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, t, n, k in brute(rows)]
    assert Counter(map(tuple, op13_shared_lines(spark, SF).collect())) == Counter(want)
