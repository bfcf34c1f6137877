import hashlib

import pytest
from pyspark.sql import functions as F

from landq.operators import merkle


def plain_levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([hashlib.sha256(f"node:{row[i]}{row[i + 1]}".encode()).hexdigest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return out


SIZES = {"one": 1, "two": 2, "three": 3, "five": 5, "full": 256, "above": 257, "large": 700}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(tree, i, hashlib.sha256(f"{tree}{i}".encode()).hexdigest()) for tree, n in SIZES.items() for i in range(n)]
    return merkle.tree_nodes(spark.createDataFrame(rows, "tree string, pos long, digest string").repartition(3)).cache()


def test_all_nodes(nodes):
    got = {}
    for r in nodes.collect():
        got.setdefault(r.tree, {}).setdefault(r.level, {})[r.pos] = r.digest
    for tree, n in SIZES.items():
        want = plain_levels([hashlib.sha256(f"{tree}{i}".encode()).hexdigest() for i in range(n)])
        assert [[level[i] for i in range(len(level))] for _, level in sorted(got[tree].items())] == want


def test_proofs_lead_to_the_root(nodes):
    found = merkle.proofs(nodes).join(merkle.roots(nodes), "tree")
    rows = found.withColumn("ok", merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).collect()
    assert len(rows) == sum(SIZES.values()) and all(r.ok for r in rows)
    assert max(len(r.proof) for r in rows) == 10
    wrong = found.filter("pos > 0").withColumn("digest", F.sha2("digest", 256))
    assert wrong.filter(merkle.folded(F.col("digest"), F.col("proof")) == F.col("root")).count() == 0


def test_a_node_is_no_leaf(spark):
    df = spark.range(1).select(merkle.leaf_hash(F.lit("a"), F.lit("b")).alias("l"), merkle.node_hash(F.lit("a"), F.lit("b")).alias("n"))
    assert df.first().l == hashlib.sha256(b'leaf:["a","b"]').hexdigest() and df.first().l != df.first().n


def test_no_leaves(spark):
    nodes = merkle.tree_nodes(spark.createDataFrame([], "tree string, pos long, digest string"))
    assert nodes.count() == 0 and merkle.proofs(nodes).count() == 0
