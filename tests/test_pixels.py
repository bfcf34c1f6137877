"""Measures of stacked tiles against loops over pixels, and the image queries where rows of tiles are missing."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from landq.functions import pixels as P
from landq.plans.catalogue import CATALOGUE
from tests_support_tables import copy_tables


def variance(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def looped(g):
    h, w = g.shape
    at = lambda s, y, x: int(s[y][x])
    half = g[::2, ::2]
    blur, noise, residual = 200.0, 0.0, 0.0
    inner = lambda s: [(y, x) for y in range(1, s.shape[0] - 1) for x in range(1, s.shape[1] - 1)]
    near = lambda s, y, x: at(s, y - 1, x) + at(s, y + 1, x) + at(s, y, x - 1) + at(s, y, x + 1)
    if min(h, w) >= 5:
        blur = variance([near(half, y, x) - 4 * at(half, y, x) for y, x in inner(half)])
        residual = variance([at(g, y, x) - near(g, y, x) / 4 for y, x in inner(g)])
    if min(h, w) >= 10:
        box = lambda y, x: sum(at(half, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
        noise = min(1.0, variance([at(half, y, x) - box(y, x) for y, x in inner(half)]) / 150)
    dy = [abs(at(g, y, x) - at(g, y - 1, x)) for y in range(1, h) for x in range(w)]
    dx = [abs(at(g, y, x) - at(g, y, x - 1)) for y in range(h) for x in range(1, w)]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return (blur, noise, residual), (mean(g.reshape(-1).tolist()), variance(g.reshape(-1).tolist()) ** 0.5, mean(dy), mean(dx))


def test_stacked_tiles():
    rng = np.random.default_rng(2)
    shapes = [(1, 1), (1, 9), (4, 16), (5, 5), (6, 5), (9, 12), (10, 10), (16, 16), (16, 16), (5, 5), (13, 30)]
    tiles = [rng.integers(0, 256 if i % 2 else 20, s) for i, s in enumerate(shapes)]
    args = pd.Series([t.reshape(-1).astype(np.int32) for t in tiles]), pd.Series([s[0] for s in shapes]), pd.Series([s[1] for s in shapes])
    metrics, signatures = P._metrics_udf.func(*args), P._signature_udf.func(*args)
    for i, g in enumerate(tiles):
        want = looped(g)
        assert np.allclose(metrics.iloc[i], want[0]) and np.allclose(signatures.iloc[i], want[1]), shapes[i]
    none = pd.Series([], dtype=object), pd.Series([], dtype=int), pd.Series([], dtype=int)
    assert len(P._metrics_udf.func(*none)) == 0


@pytest.mark.parametrize("name", ["f1_tile_metrics", "f2_residual_noise", "w5_noise_outliers"])
def test_incomplete_tiles(spark, tmp_path, name):
    # gaps and a cut-off end: tiles of one, two and three rows of embeddings
    copy_tables(spark, tmp_path, "embeddings", "vec_id % 7 <> 3 and vec_id % 11 < 9")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = CATALOGUE[name].run(spark, str(tmp_path))
    cur = con.execute(CATALOGUE[name].sql)
    names = [d[0] for d in cur.description]
    rounded = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(tuple(r[n] for n in names) for r in got.collect()) == rounded(cur.fetchall())


#: A tile whose residual is a tie of hundredths exactly, and less in the floating-point variance of the SQL.
TIE = (
    "b7889e0a9b8c9a8c9d3d8cb0cd98a37081b2c9618b9d837d8999b0d1a97e76ada268a985c57c868994c1915c889c70b573c3e8a896bf9aa282839595b4a9b58a"
    "be9e7596a7bb8594c39fba43a97fbb9888c99bd28ca9748da7f39957a18f9c8455b16193b5a9a1a19797d2d7c7aa5672a39a9ba769a0815ddcc5abafa4998841"
    "9fa999ae75a168a5bbfc7bf898b0bbacc87d9d9d9388c9d47cc18bc5c190c2a274c2beacaaab91eeeb74cf9fbee7b19f6ccbecb9cba59de6b7889ba66090c978"
    "96debc89779e7eeda3567d7588a69094dba9d0c8a58ac092a296cdd5d3aa8f8576afa79c87d9e4acc86f86939a83c4ce3487aebe6de4cb8ba4a67aaac46aab96"
)


def test_residual_is_rounded_as_the_sql_rounds_it(spark, tmp_path):
    pixels = np.frombuffer(bytes.fromhex(TIE), dtype=np.uint8).reshape(4, 64)
    rows = [(i, ((row + 0.5 - 160) / 300).tolist(), 0) for i, row in enumerate(pixels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    entry, con = CATALOGUE["f2_residual_noise"], duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in entry.run(spark, str(tmp_path)).collect()]
    assert got == con.execute(entry.sql).fetchall() == [(0, 0, 0, 132712)]
