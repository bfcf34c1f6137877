import glob
import hashlib
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landq.llm.lexicon import Lexicon, Merges, coded, compiled, op6_bpe
from landq.llm.packing import Room, best_fit, cut, op8_packing, pack, sequences
from landq.llm.token_files import digest, op3_token_files, read_index, read_tokens, write_tokens
from landq.llm.vocabulary import ByteEncoder, WordEncoder, vocabulary_path
from landq.session import shared_path

SF = "/root/testdata/sf0.001"


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("kind", "name"), [(ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_encoders_equal_the_library(spark, odd_docs, kind, name):
    tok, made = library(name), kind(vocabulary_path(name))
    texts = [r.text or "" for r in odd_docs.collect()] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [a + b + c for a in ("x", "é", "1", ".", "'s", "") for b in (" ", "\n", "  ", " \n", "\n ", "\t ", "\n\n\n", "\x1c", " ") for c in ("y", "'ll", ",", " ", "")]
    for text in texts:
        want = ids_of(tok, text)
        assert made.encode(text) == struct.pack(f"<{len(want)}I", *want), repr(text[:80])


@pytest.mark.parametrize(("kind", "name"), [(ByteEncoder, "byte_bpe_50k.json"), (WordEncoder, "word_bpe_49k.json")])
def test_every_letter(kind, name):
    # letters that change length in lower case among them, such as the first of Istanbul in Turkish
    tok, made = library(name), kind(vocabulary_path(name))
    for c in map(chr, range(0x21, 0x3000)):
        if c.isalpha() or c.isnumeric():
            text = f"{c} a{c}b {c.upper()}x. x{c}, A{c}"
            want = ids_of(tok, text)
            assert made.encode(text) == struct.pack(f"<{len(want)}I", *want), hex(ord(c))
    for text in ("İstanbul İZMİR, dİyarbakır. İ İİ. Iİı", "don't Don'T. ABC. É. ÉCOLE, École"):
        want = ids_of(tok, text)
        assert made.encode(text) == struct.pack(f"<{len(want)}I", *want), text


def test_op3_query(spark):
    """The query's rows against the library, document by document."""
    tok, at = library("word_bpe_49k.json"), 0
    want = []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*ids_of(tok, r.text), 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, op3_token_files(spark, SF).collect())) == want


def test_op6_query(spark):
    tok = library("byte_bpe_50k.json")
    tok.no_truncation()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = ids_of(tok, r.text)
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op6_bpe(spark, SF).collect())) == sorted(want)


def test_op8_query(spark):
    """Pieces of the query: ids of the library, cut without a gap, in sequences without a gap."""
    tok = library("byte_bpe_50k.json")
    ids = {r.doc_id: [*ids_of(tok, r.text), 1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, sequences_ = {}, {}
    for r in op8_packing(spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences_.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held, size in [*((pieces[d], len(i)) for d, i in ids.items()), *((s, None) for s in sequences_.values())]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at == size if size else at <= 2048
    assert pieces.keys() == ids.keys()


def test_token_files(spark, odd_docs):
    path = shared_path(spark, "test-tokens")
    write_tokens(odd_docs, path)
    tok = library("word_bpe_49k.json")
    rows = digest(read_tokens(spark, path)).orderBy("start").collect()
    source = odd_docs.collect()
    assert len(rows) == len(source)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in source), key=lambda i: -1 if i is None else i)
    want = sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(b"".join(struct.pack("<I", i) for i in [*ids_of(tok, r.text), 1]))) for r in source)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [tuple(r) for r in read_index(spark, path).orderBy("start").collect()] == [(r.doc_id, r.start, r.n_tokens) for r in rows]


def test_token_files_layout(spark):
    path = shared_path(spark, "test-tokens")
    write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path)
    local = path.removeprefix("file:")
    for file in glob.glob(f"{local}/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert "RLE_DICTIONARY" in columns["tokens"].encodings
        assert columns["doc_id"].has_column_index and columns["tokens"].has_offset_index
    one = read_tokens(spark, path).filter("doc_id = 17")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan
    scans = [x for x in read_index(spark, path)._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    assert scans and all("tokens:" not in x.split("ReadSchema")[1] for x in scans)
    assert one.count() == 1


def test_token_files_empty(spark, no_docs):
    path = shared_path(spark, "test-tokens")
    write_tokens(no_docs, path)
    assert read_tokens(spark, path).count() == 0


def test_automaton():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "é", "éa", " x", "stops"])}
    lexicon = Lexicon(compiled(words))
    for word, ids in words.items():
        assert lexicon.find(word) == struct.pack("<2I", *ids)
    assert [lexicon.find(w) for w in (b"", b"t", b"tapss", b"q", b"stop")] == [None] * 5
    endings = {frozenset(w[n:] for w in words if w.startswith(v[:n])) for v in words for n in range(len(v) + 1)}
    assert len(lexicon.first) - 1 == len(endings)  # one state for each set of continuations
    assert Lexicon(compiled({})).find(b"x") is None


def test_lexicon_coding(spark, odd_docs, no_docs):
    tok = library("byte_bpe_50k.json")
    docs = odd_docs.select("doc_id", "text").unionAll(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for words in (0, 50, 5000):
        rows = coded(docs, words=words).collect()
        want = sorted((str(r.doc_id), ids_of(tok, r.text)) for r in docs.collect())
        assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
        assert all(r.decoded == tok.decode(list(r.ids), skip_special_tokens=False) for r in rows)
    assert coded(no_docs).count() == 0


def test_merges_are_the_models():
    made, tok = Merges(vocabulary_path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for word in (" hello", "antidisestablishmentarianism", "aaaaaaaaaaaa", "naïveté", "1234567", "\n"):
        assert made.merge(word.encode()) == ids_of(tok, word) == list(made.fast(word.encode()))


def naive_best_fit(lengths, window):
    open_, used = [], 0
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(open_) if room >= length]
        if fits:
            open_[min(fits, key=lambda i: open_[i])] -= length
        else:
            open_.append(window - length)
            used += 1
    return used, sorted(open_)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_over_the_histogram(seed):
    import random
    from collections import Counter

    rng = random.Random(seed)
    window = rng.choice([1, 7, 16, 100])
    lengths = [min(window, max(1, int(rng.expovariate(3 / window)))) for _ in range(rng.choice([0, 1, 30, 400]))]
    rooms: dict = {}
    counts = Counter(lengths)
    seen: Counter = Counter()
    for length, first, until, each, sequence, base in best_fit(dict(counts), window):
        assert seen[length] == first
        seen[length] = until
        for r in range(first, until):
            s, at = sequence + (r - first) // each, base + (r - first) % each * length
            rooms.setdefault(s, []).append((at, length))
    assert seen == counts
    for places in rooms.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    used, left = naive_best_fit(lengths, window)
    assert len(rooms) == used and sorted(rooms) == list(range(used))
    assert sorted(window - sum(n for _, n in p) for p in rooms.values()) == left


def test_room():
    room = Room(16)
    assert room.tightest(1) is None
    for c in (3, 9, 16):
        room.put(c, (c, c + 1))
    assert [room.tightest(s) for s in (1, 3, 4, 9, 10, 16)] == [3, 3, 9, 9, 16, 16]
    room.take(9)
    assert room.tightest(4) == 16


def test_packing(spark, odd_docs, no_docs):
    tok = library("byte_bpe_50k.json")
    window = 64
    placed = pack(odd_docs, window=window)
    rows = placed.collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(tok, r.text)) + 1 for r in odd_docs.collect())
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    whole = {r.sequence_id: r for r in sequences(placed, window).collect()}
    assert set(whole) == set(by_sequence) and all(len(r.ids) == window for r in whole.values())
    assert cut(no_docs).count() == 0 and pack(no_docs).count() == 0
    null = placed.filter("doc_id is null").agg(F.sum("length")).first()[0]
    assert null == len(ids_of(tok, odd_docs.filter("doc_id is null").first().text)) + 1
