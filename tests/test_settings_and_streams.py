"""Rule tables with history, regional digits, signatures, streams over folders, and queries tested without SQL."""

import functools
import hashlib
import hmac
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from landq.functions.hashing import hmac_sha256
from landq.functions.text import parse_share, to_number
from landq.operators import audit
from landq.operators.confidence import DEFAULT_AGREEMENT, format_score
from landq.plans.catalogue import CATALOGUE, streams, workflow
from landq.sources import rulebook as rb
from landq.sources.rulebook import RuleBook, rules_table
from landq.streaming.sources import stream_table

SF = "/root/testdata/sf0.001"


def test_rule_table_with_history(spark):
    now = rules_table(spark).withColumn("ts", F.lit(5))
    older = now.filter(F.col("rule_id") == rb.SHARES).withColumn("ts", F.lit(1)).withColumn("enabled", F.lit(False))
    many = older
    for i in range(2, 5):
        many = many.unionByName(older.withColumn("ts", F.lit(i)))
    book = RuleBook.from_table(many.unionByName(now).unionByName(now))
    assert len(book.rules) == 10 and book.enabled(rb.SHARES)
    assert book.rules[rb.HOLDING].applies_to == RuleBook.default().rules[rb.HOLDING].applies_to


def test_rule_table_errors(spark):
    table = rules_table(spark)
    strange = table.limit(1).withColumn("rule_id", F.lit("RULE_OF_THUMB"))
    with pytest.raises(ValueError, match="unknown rule RULE_OF_THUMB"):
        RuleBook.from_table(table.unionByName(strange))
    with pytest.raises(ValueError, match="no settings for RULE_SHARE"):
        RuleBook.from_table(table.filter(F.col("rule_id") != rb.SHARES))
    twice = table.filter(F.col("rule_id") == rb.SHARES).withColumn("enabled", F.lit(False))
    with pytest.raises(ValueError, match="several settings for RULE_SHARE"):
        RuleBook.from_table(table.unionByName(twice))


def test_regional_digits(values):
    assert values(parse_share, "१/२", "૨૫%", "౦.౫", "1/२") == [0.5, 0.25, 0.5, 0.5]
    assert values(to_number, "१२.५", "૧e૨", "12d", None) == [12.5, 100.0, None, None]
    assert values(lambda v: format_score(F.lit("survey_no"), v), "१४२/३", "142/3", "x") == [1.0, 1.0, 0.6]
    assert values(lambda v: format_score(F.lit("reg_date"), v), "१२-०३-२०२०", "2020/1/1", "12.3") == [1.0, 1.0, 0.4]
    assert values(lambda v: format_score(F.lit("owner_share"), v), "१/२", "५०%", "half") == [1.0, 1.0, 0.4]
    assert values(lambda v: format_score(F.lit("area"), v), "१२", "-१", "x") == [1.0, 0.2, 0.3]


@pytest.mark.parametrize("key", ["", "k", "first-secret", "ключ", "x" * 64, "y" * 65, "z" * 200])
def test_signatures(values, key):
    bodies = ["", "body", '{"a":"é😀"}']
    want = [hmac.new(key.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]
    assert values(lambda v: hmac_sha256(v, F.lit(key)), *bodies) == want


def test_signing_stays_out_of_python(spark):
    plan = CATALOGUE["s16_signed_outbox"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The test tables as folders of several files."""
    root = tmp_path_factory.mktemp("folders")
    for name in ("documents", "orders", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(4).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("name", ["t1_stream_ingest", "t1_stream_checks", "t2_activity_counts", "t3_admission_control", "t4_audit_stream"])
def test_streams_over_folders(spark, folders, name):
    run = CATALOGUE[name].run
    assert same(run(spark, folders), run(spark, SF))


@pytest.mark.parametrize("name", ["t1_stream_ingest", "t1_stream_history"])
def test_uploads_over_several_triggers(spark, tmp_path, monkeypatch, name):
    """Files of far and falling ids, one a trigger, with copies across them, against the query's own SQL."""
    folder, files = tmp_path / "documents.parquet", set()
    for at, first in enumerate([900_001, 500_001, 1]):
        rows = [(first + 2 * i, f"text {i + 5 * at}") for i in range(10)] + [(first + 1, f"even {at}"), (first + 101, "even 0")]
        part = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        part.write.mode("append").parquet(str(folder))
        for f in set(folder.glob("*.parquet")) - files:
            os.utime(f, (1_000_000 + at * 100, 1_000_000 + at * 100))
            files.add(f)
    monkeypatch.setattr(streams, "stream_table", functools.partial(stream_table, trigger_bytes=1))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    want = sorted(r[0] for r in con.execute(CATALOGUE[name].sql).fetchall())
    assert sorted(r.sha256 for r in CATALOGUE[name].run(spark, str(tmp_path)).collect()) == want


def test_a_stream_without_files_is_an_error(spark, folders):
    with pytest.raises(Exception, match="(?i)not.exist|not_found"):
        stream_table(spark, folders, "nothing")
    assert stream_table(spark, folders, "events").isStreaming and streams.LIMIT == 2


def test_heads_show_what_the_log_cannot(spark):
    log = workflow.chained(spark, SF).cache()
    heads = audit.segment_heads(log, "user_id")
    linked = {(r.chain_id, r.segment): r.head_hash for r in audit.linked_heads(heads).collect()}
    chain, last = heads.groupBy("chain_id").agg(F.max("segment")).filter("max(segment) >= 2").first()
    now = "0" * 64
    for r in sorted(heads.filter(F.col("chain_id") == chain).collect(), key=lambda r: r.segment):
        now = hashlib.sha256(f"{now}:{r.segment}:{r.last_hash}".encode()).hexdigest()
        assert linked[chain, r.segment] == now
    cut = log.filter(~((F.col("user_id") == chain) & (F.col("segment") == last)))
    assert [tuple(r) for r in audit.missing_tails(cut, heads, "user_id").collect()] == [(chain, last)]
    gone = log.filter(~((F.col("user_id") == chain) & (F.col("segment") == 1)))
    summary = audit.chain_summary(audit.verify_chain(gone, "user_id", workflow.HASHED, workflow.SEGMENT), "user_id")
    assert [r.user_id for r in summary.filter("not chain_valid").collect()] == [chain]
    log.unpersist()


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = 0
        for j, d in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if c == d else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def slow_partial(a, b):
    """Best window of the longer text that is as long as the shorter one, cut off at both ends too."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
    return max((slow_ratio(short, w) for w in windows if w), default=0.0)


def test_engine_agreement_by_brute_force(spark):
    """j9_engine_agreement has no SQL: windows over whole texts are too slow there."""
    texts = {r.doc_id: (r.text or "").lower() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in CATALOGUE["j9_engine_agreement"].run(spark, SF).collect()]
    assert len(rows) == len(texts)
    for r in rows[::9]:
        word = ((texts.get(r.document_id + 1) or "").split() or [""])[0]
        page = texts.get(r.document_id, "")
        if not word or not page:
            want = DEFAULT_AGREEMENT
        elif word in page:
            want = 1.0
        else:
            want = int(max(0.4, slow_partial(word, page) / 100) * 100 + 0.5) / 100
        assert abs(r.agreement - want) < 1e-9, (r, word)
