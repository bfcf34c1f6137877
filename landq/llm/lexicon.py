"""BPE encoding with a lexicon of frequent words as a minimal acyclic transducer, and decoding.

The most frequent words of the whole corpus are compiled, in sorted order, into an automaton that shares suffixes: two
states with the same continuations are one. Arcs carry numbers that add up to a word's number, which leads to its ids.
The automaton is a few flat arrays in one file image; each worker maps it into memory and walks it byte by byte. Words
that are not in it are merged pair by pair, in the order of the vocabulary's merges, which is what the library does.

How many words are compiled bounds the image, whatever the corpus; it changes speed only, never ids.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import Rows, per_worker, rows_of, stored, table
from landq.llm.vocabulary import BYTE_PATTERN, IRREGULAR, LATIN, Kept, byte_letters, packed, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS = 40_000
#: Words met fewer times are not worth an entry.
LEAST_COUNT = 3
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000
KEPT_WORDS, KEPT_PIECES = 600_000, 100_000
MAGIC = b"LEX1"


class Merges:
    """A byte-level vocabulary file: pieces by exact merges, and bytes by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        ids = known["model"]["vocab"]
        letters = byte_letters()
        self.single = [ids[chr(letters[b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(known["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[ids[a], ids[b]] = (rank, ids[a + b])
        self.special = {x["content"]: x["id"] for x in known["added_tokens"]}
        byte_of = {chr(c): b for b, c in letters.items()}
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        merged = [new for _, new in self.rank.values()]
        self.fast = None
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            # ids rise with the merges' ranks, so a compiled merger that goes by ids does the same
            import tiktoken

            special = set(self.special.values())
            ranks = {raw: i for i, raw in self.bytes.items() if i not in special}
            self.fast = tiktoken.Encoding("lexicon", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair with the lowest rank is merged first, the leftmost of equals."""
        parts = [self.single[b] for b in piece]
        rank = self.rank
        while len(parts) > 1:
            best = min((rank[pair] for pair in zip(parts, parts[1:], strict=False) if pair in rank), default=None)
            if best is None:
                break
            merged, i, out = best[1], 0, []
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                    out.append(merged)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


def compiled(words: dict[bytes, list[int]]) -> bytes:
    """File image of the minimal automaton of some words and their ids."""
    states: list[dict[int, int]] = [{}]  # arcs: byte to state
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []

    def reduced(state: int) -> int:
        """The registered state with the same continuations, or this one."""
        key = (final[state], tuple(sorted(states[state].items())))
        same = register.setdefault(key, state)
        if same != state:
            free.append(state)
        return same

    path, last = [0], b""
    for word in sorted(words):
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for at in range(len(last), shared, -1):
            states[path[at - 1]][last[at - 1]] = reduced(path[at])
        del path[shared + 1 :]
        for byte in word[shared:]:
            if free:
                new = free.pop()
                states[new], final[new] = {}, False
            else:
                new = len(states)
                states.append({})
                final.append(False)
            states[path[-1]][byte] = new
            path.append(new)
        final[path[-1]] = True
        last = word
    for at in range(len(last), 0, -1):
        states[path[at - 1]][last[at - 1]] = reduced(path[at])

    number: dict[int, int] = {}  # of reached states
    below: dict[int, int] = {}  # words that end in or under a state
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in states[state].values())
        elif state not in number:
            number[state] = len(number)
            stack.append((state, True))
            stack += [(t, False) for t in states[state].values() if t not in number]
    firsts, labels, targets, outputs, ends = [0], bytearray(), [], [], bytearray()
    for state in number:  # in order of number
        add = int(final[state])
        for byte, target in sorted(states[state].items()):
            labels.append(byte)
            targets.append(number[target])
            outputs.append(add)
            add += below[target]
        firsts.append(len(labels))
        ends.append(final[state])
    id_starts, ids = [0], []
    for word in sorted(words):
        ids += words[word]
        id_starts.append(len(ids))
    pad = bytes(-(len(labels) + len(ends)) % 4)
    head = MAGIC + struct.pack("<5I", len(ends), len(labels), len(words), len(ids), len(pad))
    numbers = [*firsts, *targets, *outputs, *id_starts, *ids]
    return head + struct.pack(f"<{len(numbers)}I", *numbers) + bytes(labels) + bytes(ends) + pad


class Lexicon:
    """Reader of a mapped image."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as file:  # has no name and goes with the worker
            file.write(image)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, pad = struct.unpack_from("<5I", self.map, 4)
        view = memoryview(self.map)
        at = 24

        def numbers(n: int):
            nonlocal at
            part = view[at : at + 4 * n].cast("I")
            at += 4 * n
            return part

        self.first, self.target, self.output = numbers(states + 1), numbers(arcs), numbers(arcs)
        self.start, self.ids = numbers(words + 1), view[at : at + 4 * ids]
        self.labels = at + 4 * ids
        self.ends = self.labels + arcs
        self.words = words

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers; None if it is not in the lexicon."""
        if not self.words:
            return None
        image, labels, first, state, index = self.map, self.labels, self.first, 0, 0
        for i in range(len(word)):
            arc = image.find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            index += self.output[arc - labels]
            state = self.target[arc - labels]
        if not image[self.ends + state]:
            return None
        return bytes(self.ids[4 * self.start[index] : 4 * self.start[index + 1]])


class Coder:
    """Encodes whole texts by lexicon and merges, and decodes."""

    def __init__(self, path: str, image: bytes):
        self.merges, self.lexicon = Merges(path), Lexicon(image)
        self.merge = self.merges.fast or self.merges.merge
        self.split = regex.compile(BYTE_PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.path, self.whole = path, None
        self.pieces = Kept(self.piece, KEPT_PIECES)
        self.words = Kept(self.word, KEPT_WORDS)

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        found = self.lexicon.find(raw)
        return packed(self.merge(raw)) if found is None else found

    def part(self, text: str) -> bytes:
        if LATIN.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        # beyond Latin letters the library says where pieces end
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        bounds = [span for _, span in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(self.pieces[text[a:b]] for a, b in bounds)

    def word(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or LATIN.fullmatch(word)):
            return self.piece(" " + word)
        if word[-1] in ".,":
            body = word[:-1]
            if body.isalpha() and (body.isascii() or LATIN.fullmatch(body)):
                return self.words[body] + self.pieces[word[-1]]
        return self.part(word if word[0] == "\n" else " " + word)

    def plain(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        if IRREGULAR.search(text) or rest and not rest[-1]:
            return self.part(text)
        return b"".join([self.part(first), *map(self.words.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.merges.special):
            return self.plain(text)
        special = self.merges.special
        return b"".join(packed([special[t]]) if t in special else self.plain(t) for t in self.cut.split(text) if t)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, ids)).decode(errors="replace")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all whole texts; a word is a piece of the vocabulary's split, its blank included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, firsts, chunks = regex.compile(BYTE_PATTERN), Counter(), Counter()

        def counted() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in firsts.items():
                for word in split.findall(chunk):
                    words[word] += n
            for chunk, n in chunks.items():
                if chunk.isalpha():
                    words[" " + chunk] += n
                else:
                    for word in split.findall(chunk if chunk[:1] == "\n" else " " + chunk):
                        words[word] += n
            firsts.clear()
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for (text,) in rows_of(batch):
                # chunks begin at single blanks, as words do; how other white space is cut matters little for counts
                first, *rest = (text or "").replace("\n", " \n").split(" ")
                firsts[first] += 1
                chunks.update(rest)
                if len(chunks) >= COUNTED:
                    yield counted()
        yield counted()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_image(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> bytes:
    """Image of the most frequent words; at most ``words`` of them reach the driver.

    Counts are put into bins, sixteen for each doubling, and whole bins are taken from the top while there is room.
    """
    level = F.floor(16 * F.log2("n")).cast("int")
    counted = stored(word_counts(docs).filter(F.col("n") >= LEAST_COUNT).withColumn("level", level), "words")
    sizes = {r["level"]: r["count"] for r in counted.groupBy("level").count().collect()}  # a thousand bins at most
    least, taken = 1 << 30, 0
    for at in sorted(sizes, reverse=True):
        taken += sizes[at]
        if taken > words:
            break
        least = at
    frequent = counted.filter(F.col("level") >= least).select("word").collect()
    merges = Merges(vocabulary_path(vocabulary))
    raw = [r["word"].encode() for r in frequent]
    return compiled({w: merges.merge(w) for w in raw if w})


def coded(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (array<int>), decoded for every row of documents.

    Null text counts as empty and has no ids; repeated rows are coded each; other columns don't pass; an empty table
    gives no rows. Special tokens inside texts have their own ids.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(docs, vocabulary, words, _full), "doc_id long, ids array<int>, decoded string")


def _full(doc_id, ids: list[int], text: str) -> tuple:
    return doc_id, ids, text


def _digest(doc_id, ids: list[int], text: str) -> tuple:
    joined = str(ids)[1:-1].replace(" ", "").encode()
    return doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


FULL = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
DIGEST = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _run(docs: DataFrame, vocabulary: str, words: int, row):
    image = lexicon_image(docs, vocabulary, words)
    key = ("lexicon", vocabulary, hashlib.sha256(image).hexdigest())
    shared = docs.sparkSession.sparkContext.broadcast(image)  # bounded by the number of words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(key, lambda: Coder(vocabulary_path(vocabulary), shared.value))
        out = Rows(pa.schema(FULL if row is _full else DIGEST))
        for batch in batches:
            for doc_id, text in rows_of(batch):
                ids = memoryview(coder.encode(text or "")).cast("I").tolist()
                decoded = coder.decode(ids)
                out.add(row(doc_id, ids, decoded), len(decoded))
                if out.full():
                    yield out.take()
        yield out.take()

    return run


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_run(docs, VOCABULARY, LEXICON_WORDS, _digest), ddl)
