import duckdb
import numpy as np

from landq.llm import top_k as module
from landq.llm.queries import SQL
from landq.llm.top_k import integer_vectors, op1_top_k, search_block, top_k

SF = "/root/testdata/sf0.001"


def brute(vectors: dict, queries: list, k: int):
    width = max((len(v) for v in vectors.values()), default=0)
    padded = {i: list(v) + [0] * (width - len(v)) for i, v in vectors.items()}
    out = set()
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(padded[q], v, strict=True)), i) for i, v in padded.items() if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_blocks_ties_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ROWS", 40)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(1)
    vectors = {i: rng.integers(-3, 4, 6).tolist() for i in range(150)}
    vectors |= {200 + i: vectors[3] for i in range(30)} | {300: [], 301: [5], 302: [9, -9, 9, -9, 9, -9, 2]}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, values array<long>")
    queries = [i for i in vectors if i % 20 == 0]
    got = top_k(frame, frame.filter("vec_id % 20 = 0"), 7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(vectors, queries, 7)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-5, 6, (3000, 4))
    vectors[7] = 5000
    found = {(q, v) for q, v, _ in search_block(np.arange(3000), vectors, np.array([7]), vectors[7:8], 3)}
    exact = np.argsort(-(vectors @ vectors[7]), kind="stable")
    assert found == {(0, int(v)) for v in exact[:4] if v != 7}


def test_invalid_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]), (None, [1.0, 1.0]), (5, [0.5, -0.001]), (5, [0.5, -0.001])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, values string")
    made = {r.vec_id: r["values"] for r in integer_vectors(frame).collect()}
    assert made == {0: [1024, 2048], 5: [512, -2]}
    assert top_k(integer_vectors(frame.limit(0)), integer_vectors(frame.limit(0))).count() == 0
    one = integer_vectors(frame.filter("vec_id = 0"))
    assert top_k(one, one).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select query_id, \"rank\", vec_id, score from ({SQL['op1_top_k']})").fetchall()
    got = op1_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)
