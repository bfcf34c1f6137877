import hashlib
import zlib
from collections import Counter

import pytest

from landq.llm import manifest
from landq.llm.manifest import checked, fold, leaves, nodes, op12_manifest, proofs, ranked

SF = "/root/testdata/sf0.001"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows, bump=lambda r: 0):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by the plain definition."""

    def leaf(r, add=0):
        n = None if r.n_chars is None else r.n_chars + add
        return h(*map(part, (r.doc_id, r.source, r.lang, n, r.text)))

    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    made = {t: levels([leaf(r) for r in trees[t]]) for t in order}
    upper = levels([made[t][-1][0] for t in order])
    out = []
    for place, t in enumerate(order):
        for rank, r in enumerate(trees[t]):
            folded, proof = leaf(r, bump(r)), ""
            for tree, i in ((made[t], rank), (upper, place)):
                for level in tree[:-1]:
                    run = level[i // 2 * 2 : i // 2 * 2 + 2]
                    proof += "".join(run[:i % 2] + run[i % 2 + 1 :])
                    run[i % 2] = folded
                    folded, i = h(*run), i // 2
            out.append((r.doc_id, leaf(r), made[t][-1][0], upper[-1][0], h(proof), folded, folded == upper[-1][0]))
    return out


def tampered(r):
    return 0 if r.doc_id is None else int(zlib.crc32(str(r.doc_id).encode()) % 7 == 0)


def made_docs(spark, sizes, columns=""):
    rows = [(i * 3, f"text {i} é", lang, None if i % 5 == 0 else "s", None if i % 11 == 0 else i) for lang, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("span", [2, 8])
def test_shapes_of_trees(spark, monkeypatch, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    docs = made_docs(spark, {"one": 1, "two": 2, "three": 3, "é": 5, "a": 16, "b": 17, "large": 333, None: 9})
    got = checked(proofs(leaves(docs)))
    assert Counter(map(tuple, got.collect())) == Counter(brute(docs.collect()))


def test_one_tree_and_one_row(spark):
    for sizes in ({"en": 300}, {"en": 1}, {None: 2}):
        docs = made_docs(spark, sizes)
        assert Counter(map(tuple, checked(proofs(leaves(docs))).collect())) == Counter(brute(docs.collect()))


def test_labels(spark):
    docs = made_docs(spark, {"x": 700, "y": 3})
    ranks = ranked(leaves(docs))
    made = [r for n in nodes(ranks) for r in n.collect()]
    assert {r.level for r in made if r.tree == "x"} == set(range(1, 11))
    for r in made:
        size = {"x": 700, "y": 3}[r.tree]
        assert r.lo % (1 << r.level) == 0 and r.hi == min(r.lo + (1 << r.level), size) - 1
        below = [c for c in made if c.tree == r.tree and c.level == r.level - 1 and r.lo <= c.lo and c.hi <= r.hi]
        if r.level > 1:
            assert manifest.node_digest([bytes(c.digest) for c in sorted(below, key=lambda c: c.lo)]) == bytes(r.digest)


def test_odd_rows(spark, odd_docs, no_docs):
    # null and repeated ids, repeated rows, further columns
    got = checked(proofs(leaves(odd_docs)))
    assert Counter(map(tuple, got.collect())) == Counter(brute(odd_docs.collect()))
    assert checked(proofs(leaves(no_docs))).collect() == []


def test_missing_node(spark):
    import pyarrow as pa

    rows = [dict(kind=0, lo=i, hi=i, level=0, tree="t", id=i, digest=b"x", claimed=None, proof=None, subroot=None, root=None) for i in range(2)]
    rows.append(dict(kind=1, lo=1, hi=1, level=1, tree="t", id=None, digest=b"y", claimed=None, proof=None, subroot=None, root=None))
    with pytest.raises(ValueError):
        manifest._attach(0, pa.int64())(pa.Table.from_pylist(rows))


def test_fold():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    assert fold(a, b"") == a
    assert fold(a, bytes([manifest.AFTER]) + b + bytes([manifest.ALONE]) + bytes([manifest.BEFORE]) + c).hex() == h(c.hex(), h(h(a.hex(), b.hex())))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op12_manifest(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, tampered))
    assert 0 < sum(not r.verified for r in got) < len(got) / 4
