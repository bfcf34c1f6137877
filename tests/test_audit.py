import pytest
from pyspark.sql import functions as F

from landq.functions.hashing import GENESIS, chain_step, hmac_sha256
from landq.operators import audit

HASHED = ["id", "action"]
SEGMENT = 4


@pytest.fixture(scope="module", params=[5, 1_000_000], ids=["hot", "plain"])
def log(spark, request):
    rows = [(c, t, f"{c}{t}", "VIEW") for c in ("a", "b") for t in range(11)]
    events = spark.createDataFrame(rows, "chain string, t int, id string, action string").repartition(3)
    splits = [F.floor(F.col("t") / 3)]
    return audit.append_chain(events, "chain", ["t"], splits, HASHED, SEGMENT, hot_rows=request.param).cache()


def breaks(log):
    out = audit.verify_chain(log, "chain", HASHED, SEGMENT).filter("broken is not null").orderBy("chain", "seq")
    return [(r.chain, r.seq, r.broken) for r in out.collect()]


def test_first_entry_builds_on_genesis(log):
    first = log.filter("chain = 'a' and seq = 0").first()
    assert first.previous_hash == GENESIS
    assert first.current_hash == chain_step(GENESIS, '["a","0","a0","VIEW"]')
    assert log.count() == 22


def test_clean_chain(log):
    assert breaks(log) == []
    summary = audit.chain_summary(audit.verify_chain(log, "chain", HASHED, SEGMENT), "chain").orderBy("chain").collect()
    assert [(r.total_blocks, r.chain_valid, r.broken_at) for r in summary] == [(11, True, None)] * 2


def test_edited_entry_is_located(log):
    edited = log.withColumn("action", F.when(F.col("id") == "a2", "EDIT").otherwise(F.col("action")))
    assert breaks(edited) == [("a", 2, "content")]


def test_edited_entry_with_a_new_hash_breaks_the_next_link(log):
    forged = log.withColumn("current_hash", F.when(F.col("id") == "a1", F.lit("f" * 64)).otherwise(F.col("current_hash")))
    assert breaks(forged) == [("a", 1, "content"), ("a", 2, "link")]


def test_missing_entry_breaks_the_link_after_it(log):
    assert breaks(log.filter("id <> 'b5'")) == [("b", 6, "link")]


def test_missing_tail_shows_in_the_heads(log):
    heads = audit.segment_heads(log, "chain")
    assert audit.missing_tails(log, heads, "chain").count() == 0
    cut = log.filter("not (chain = 'a' and seq >= 9)")
    assert breaks(cut) == []
    assert [tuple(r) for r in audit.missing_tails(cut, heads, "chain").collect()] == [("a", 2)]


def test_signature_known_value(spark):
    df = spark.createDataFrame([("what do ya want for nothing?", "Jefe")], "body string, secret string")
    want = "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert df.select(hmac_sha256(F.col("body"), F.col("secret"))).first()[0] == want


def kinds(log, heads):
    return sorted((r.chain_id, r.seq, r.broken) for r in audit.sealed_breaks(log, heads, "chain", SEGMENT).collect())


def test_heads_show_cut_removed_and_rewritten(spark, log):
    heads = audit.segment_heads(log, "chain")
    assert kinds(log, heads) == []
    assert kinds(log.filter("not (chain = 'a' and seq >= 9)"), heads) == [("a", 9, "missing")]
    assert kinds(log.filter("not (chain = 'a' and seq >= 3)"), heads) == [("a", 3, "missing"), ("a", 4, "missing"), ("a", 8, "missing")]
    assert kinds(log.filter("chain = 'a'"), heads) == [("b", s, "missing") for s in (0, 4, 8)]
    entered = log.select("chain", "t", "id", F.when(F.col("id") == "a5", "EDIT").otherwise(F.col("action")).alias("action"))
    forged = audit.append_chain(entered, "chain", ["t"], [F.col("t")], HASHED, SEGMENT)
    assert breaks(forged) == []
    assert kinds(forged, heads) == [("a", 4, "rewritten")]


def test_older_heads_allow_growth(log):
    heads = audit.segment_heads(log.filter("seq < 6"), "chain")
    assert kinds(log, heads) == []
    assert kinds(log.filter("seq <> 5"), heads) == [("a", 5, "missing"), ("b", 5, "missing")]


def test_hole_is_missing_when_it_ends_a_segment(log):
    holed = log.filter("id <> 'b7'")
    assert breaks(holed) == [("b", 8, "link")]
    summary = audit.chain_summary(audit.verify_chain(holed, "chain", HASHED, SEGMENT), "chain", audit.sealed_breaks(holed, audit.segment_heads(log, "chain"), "chain", SEGMENT))
    assert {r.chain: (r.total_blocks, r.chain_valid, r.broken_at, r.break_kind) for r in summary.collect()} == {
        "a": (11, True, None, None),
        "b": (10, False, 7, "missing"),
    }


def test_summary_with_heads(log):
    now = log.filter("chain = 'a'").withColumn("action", F.when(F.col("seq") == 4, "EDIT").otherwise(F.col("action")))
    sealed = audit.sealed_breaks(now, audit.segment_heads(log, "chain"), "chain", SEGMENT)
    out = {r.chain: r for r in audit.chain_summary(audit.verify_chain(now, "chain", HASHED, SEGMENT), "chain", sealed).collect()}
    assert (out["a"].broken_at, out["a"].break_kind, out["a"].total_blocks) == (4, "content", 11)
    assert (out["b"].broken_at, out["b"].break_kind, out["b"].total_blocks, out["b"].latest_hash) == (0, "missing", 0, None)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_seals(log, hot):
    heads = audit.batch_heads(log.withColumn("batch", F.floor(F.col("t") / 3)), "chain", "batch", SEGMENT)
    nodes = audit.sealed_tree(heads, hot)
    seals = audit.batch_seals(nodes)
    assert [r.heads for r in seals.orderBy("batch").collect()] == [2, 4, 4, 2]
    assert all(r.valid for r in audit.seal_breaks(heads, seals).collect())
    forged = heads.withColumn("last_hash", F.when((F.col("batch") == 1) & (F.col("segment") == 1) & (F.col("chain_id") == "a"), F.lit("0" * 64)).otherwise(F.col("last_hash")))
    assert {r.batch: r.valid for r in audit.seal_breaks(forged, seals).collect()} == {0: True, 1: False, 2: True, 3: True}
    gone = heads.filter("not (batch = 3 and chain_id = 'b')")
    assert {r.batch: r.valid for r in audit.seal_breaks(gone, seals).collect()} == {0: True, 1: True, 2: True, 3: False}
    assert audit.seal_breaks(heads.filter("batch > 0"), seals).filter("not valid").count() == 1
