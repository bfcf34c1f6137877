import zlib

import corpus_pipeline
from test_near_duplicates import brute as near_brute
from test_outliers import expected
from test_repeats import brute as repeat_brute

from landq.llm.common import stored
from landq.llm.repeats import kept_text
from landq.llm.vocabulary import ByteEncoder, packed, vocabulary_path

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        if name == "quality":
            verdicts = expected([(r.lang, r.source, r.text) for r in rows])
            want = {r.doc_id: r.text for r, v in zip(rows, verdicts, strict=True) if v[6]}
        elif name == "near_duplicates":
            found = near_brute([(r.doc_id, r.text) for r in rows], 5)
            want = {r.doc_id: r.text for r, (_, c) in zip(rows, found, strict=True) if r.doc_id == c}
        else:
            runs = repeat_brute([r.text for r in rows], 200)
            want = {r.doc_id: kept_text(r.text.encode(), x) for r, x in zip(rows, runs, strict=True)}
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    encode = ByteEncoder(vocabulary_path("byte_bpe_50k.json")).encode
    ids = {r.doc_id: encode(r.text) + packed([1]) for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert all(zlib.crc32(ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(x) // 4 for x in ids.values())


def test_run_equals_stages(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "packing"]


def test_empty(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
