"""Phrases whose words occur together more often than apart, counted in tiles of frequency-ranked ids.

1. Words are counted over all texts. The most frequent ones, ``WORDS`` at most, get ids by rank.
2. Two neighbouring ids name a cell of a tile of ``SIDE`` x ``SIDE`` pairs. Ranks put most pairs into the tiles at the
   corner: these have an array with a place for each cell (``bincount``). Pairs of all other tiles are kept as sorted
   coordinates with counts. Tasks count what they hold before anything is shuffled; the counts of a corner tile are
   added up in two rounds, those of the others are dealt finely.
3. Frequent pairs are ranked in turn, ``PAIRS`` at most have ids, and a pair's id with the next word's id is counted in
   the same way, which gives phrases of three words.
4. Phrases with words or pairs beyond the two lists are counted as plain rows. All parts of a frequent phrase are
   frequent, so bitmaps of the frequent words and pairs beyond the lists (of fixed size; a false hit costs a row and
   changes nothing) keep most others out, and the step is left out where the lists hold all that is frequent enough.

Texts are taken whole, null as empty; a null lang counts as ``und``. Words and pieces are told by ASCII characters only,
so bytes are as good as characters. Equal scores are ordered by frequency, then by phrase; repeated rows count each
time; other columns don't pass; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landq.llm.common import Rows, rows_of, stored, table, task_number

LEAST = 10
TOP = 2000
#: Words and pairs that have ids: some 40 bytes each, which the driver and every worker hold.
WORDS, PAIRS = 1 << 20, 1 << 21
#: Places in a bitmap of what is frequent beyond these lists; 32 MB at most.
BITMAP_BITS = 28
SIDE_BITS = 11
SIDE = 1 << SIDE_BITS
#: Tiles (i, j) with (i + 1) * (j + 1) up to this are counted with a place for each cell.
CORNER = 8
CORNER_TILES = [(i, j) for i in range(CORNER) for j in range(CORNER) if (i + 1) * (j + 1) <= CORNER]
#: Words or pairs that a task counts at a time.
HELD_WORDS, HELD_PAIRS = 300_000, 1 << 20
#: Occurrences of words for each deal of sparse tiles, and deals in which a corner tile is added up first.
DEALT, SALTS = 500_000, 16
#: Deals of a language's phrases whose best are found before the best of all.
RANKED = 32
BREAK, NOTHING, UNKNOWN = -1, -2, -3
#: A-Z to a-z, the ends of pieces to line feeds, tabs to blanks.
FOLDED = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" "
)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())],
                    names=["lang", "word", "n"],
                )
            counts.clear()

        for batch in batches:
            for lang, raw in rows_of(batch):
                if raw:
                    counts.setdefault(lang, Counter()).update(raw.translate(FOLDED).split())
                    if sum(map(len, counts.values())) >= HELD_WORDS:
                        yield from flushed()
        yield from flushed()

    return _texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """Rows with the largest ``n``, ``most`` at most, and whether these are all.

    Counts are put into bins, sixteen for each doubling, and whole bins are taken from the top while there is room.
    """
    level = F.floor(16 * F.log2("n")).cast("int")
    sizes = {r["level"]: r["count"] for r in counted.groupBy(level.alias("level")).count().collect()}  # a thousand bins at most
    least, taken = 1 << 30, 0
    for at in sorted(sizes, reverse=True):
        if taken + sizes[at] > most:
            return counted.filter(level >= least), False
        least, taken = at, taken + sizes[at]
    return counted, True


def _word_keys(lang: str, words: Iterable[bytes]):
    """Two halves of a 128-bit hash for each word of a language."""
    import numpy as np
    import xxhash

    name = lang.encode()
    start = b"%d:%b" % (len(name), name)
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(start + w) for w in words]), np.uint64)
    return digests[0::2], digests[1::2]


class Ranks:
    """Ids of frequent words and pairs by rank; words belong to a language."""

    def __init__(self, words: pa.Table, pairs=None):
        """words: lang, word in order of rank; pairs: arrays of left and right word ids in order of rank."""
        import numpy as np

        self.words = words["word"].combine_chunks()
        self.langs = words["lang"].combine_chunks().dictionary_encode()
        high, low = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        codes, spelled = self.langs.indices.to_numpy(), self.words.cast(pa.binary())
        for code, lang in enumerate(self.langs.dictionary.to_pylist()):
            at = np.flatnonzero(codes == code)
            for part in range(0, len(at), 10_000):
                few = at[part : part + 10_000]
                high[few], low[few] = _word_keys(lang, spelled.take(pa.array(few)).to_pylist())
        self.word_order = np.argsort(high, kind="stable").astype(np.int32)
        self.high, self.low = high[self.word_order], low[self.word_order]
        self.caches: dict[str, dict[bytes, int]] = {}
        self.left, self.right = (np.zeros(0, np.int64),) * 2 if pairs is None else pairs
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def table(self) -> pa.Table:
        return pa.table({"lang": self.langs.cast(pa.string()), "word": self.words})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"caches": {}}

    def _found(self, lang: str, words: list[bytes]) -> list[int]:
        import numpy as np

        if not len(self.high):
            return [UNKNOWN] * len(words)
        high, low = _word_keys(lang, words)
        at = np.searchsorted(self.high, high)
        out = np.full(len(words), UNKNOWN, np.int64)
        open_ = np.arange(len(words))
        while len(open_):  # words with one first half stand in a row; a second round is next to never needed
            inside = at[open_] < len(self.high)
            open_ = open_[inside]
            same = self.high[at[open_]] == high[open_]
            open_ = open_[same]
            hit = self.low[at[open_]] == low[open_]
            out[open_[hit]] = self.word_order[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
        return out.tolist()

    def ids(self, lang: str, raw: bytes):
        """Ids of a text's words in a row, with BREAK between pieces and behind the text."""
        import numpy as np

        tokens = raw.translate(FOLDED).replace(b"\n", b" \n ").split(b" ")
        tokens.append(b"\n")
        known = self.caches.get(lang)
        if known is None or len(known) > HELD_WORDS // 2:
            known = self.caches[lang] = {b"": NOTHING, b"\n": BREAK}
        new = list(set(tokens).difference(known))
        if new:
            known.update(zip(new, self._found(lang, new), strict=True))
        found = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        return found[found != NOTHING]

    def pairs(self, ids):
        """Pair id (else -1) of each id and the next one."""
        import numpy as np

        if len(ids) < 2 or not len(self.keys):
            return np.full(max(0, len(ids) - 1), -1, np.int64)
        known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        keys = np.where(known, ids[:-1] << 32 | np.maximum(ids[1:], 0), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1).astype(np.int64)


class Bits:
    """A bitmap of hashes of rows of texts, of fixed size."""

    def __init__(self, df: DataFrame, *columns: str):
        import numpy as np

        place = F.xxhash64(*columns).bitwiseAND((1 << BITMAP_BITS) - 1)
        parts = df.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        self.image = np.zeros(((1 << BITMAP_BITS) // 32768 + 2) * 4096, np.uint8)
        # 4 KB for each 32,768 places: 32 MB at most, however many rows there are; bucket 0 holds place 0 alone
        for r in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
            start = r["bucket"] * 4096
            self.image[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)

    def has(self, *values: bytes) -> bool:
        import xxhash

        seed = 42
        for value in values:
            seed = xxhash.xxh64_intdigest(value, seed=seed)
        place = seed & ((1 << BITMAP_BITS) - 1)
        at = place + 32767 if place else 0
        return bool(self.image[at >> 3] >> (at & 7) & 1)


def cell_keys(left, right):
    """Tile and cell of each pair of ids as one number: tile row, tile column, row, column."""
    mask = SIDE - 1
    return (left >> SIDE_BITS) << 33 | (right >> SIDE_BITS) << 22 | (left & mask) << SIDE_BITS | (right & mask)


def cell_ids(keys):
    mask = SIDE - 1
    return (keys >> 33) << SIDE_BITS | (keys >> SIDE_BITS) & mask, ((keys >> 22) & mask) << SIDE_BITS | keys & mask


def tallied(left, right) -> Iterator[tuple[int, object, object]]:
    """(corner tile or -1, sorted keys, counts) of the pairs: bincount for the corner, sorted coordinates for the rest."""
    import numpy as np

    keys = cell_keys(left, right)
    tiles = keys >> 22
    rest = np.ones(len(keys), bool)
    for number, (i, j) in enumerate(CORNER_TILES):
        code = i << 11 | j
        inside = tiles == code
        held = keys[inside]
        if not len(held):
            continue
        rest &= ~inside
        cells = held & (SIDE * SIDE - 1)
        if len(cells) * 16 >= SIDE * SIDE:
            dense = np.bincount(cells, minlength=SIDE * SIDE)
            at = np.flatnonzero(dense)
            yield number, at | code << 22, dense[at]
        else:
            yield number, *np.unique(held, return_counts=True)
    if rest.any():
        yield -1, *np.unique(keys[rest], return_counts=True)


def _tally(docs: DataFrame, ranks: Ranks, deals: int, triples: bool) -> DataFrame:
    """deal, salt, keys, counts: what each task counted. Deals below the number of corner tiles are these tiles."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # bounded by WORDS and PAIRS
    schema = pa.schema([("deal", pa.int64()), ("salt", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known, out, salt = shared.value, Rows(schema), task_number() % SALTS
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(held)
            held.clear()
            if triples:
                pairs = known.pairs(ids)
                left, right = pairs[:-1], np.where(pairs[1:] >= 0, ids[2:], -1)
            else:
                left, right = ids[:-1], ids[1:]
            whole = (left >= 0) & (right >= 0)
            for tile, keys, counts in tallied(left[whole], right[whole]):
                if tile >= 0:
                    out.add((tile, salt, keys.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes()), 16 * len(keys))
                else:
                    # a row of a tile's cells is dealt as one
                    deal = ((keys >> SIDE_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % deals
                    order = np.argsort(deal, kind="stable")
                    deal, keys, counts = deal[order], keys[order], counts[order]
                    starts = np.flatnonzero(np.diff(deal, prepend=-1))
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(deal)], strict=True):
                        out.add((len(CORNER_TILES) + int(deal[a]), 0, keys[a:b].tobytes(), counts[a:b].tobytes()), 16 * (b - a))
                if out.full():
                    yield out.take()

        size = 0
        for batch in batches:
            for lang, raw in rows_of(batch):
                if raw:
                    held.append(known.ids(lang, raw))
                    size += len(held[-1])
                    if size >= HELD_PAIRS:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()
        yield out.take()

    return _texts(docs).mapInArrow(run, "deal long, salt long, keys binary, counts binary")


class Sums:
    """Counts of one deal: an array of all cells for a corner tile, sorted coordinates for other tiles."""

    def __init__(self, deal: int):
        import numpy as np

        self.deal, self.held, self.size = deal, [], 0
        self.cells = np.zeros(SIDE * SIDE, np.int64) if deal < len(CORNER_TILES) else None

    def add(self, keys, counts) -> None:
        if self.cells is not None:
            self.cells[keys & (SIDE * SIDE - 1)] += counts  # keys of a row differ
            return
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > 1 << 21 and len(self.held) > 1:
            self.held = [self.total()]
            self.size = 0

    def total(self):
        import numpy as np

        if self.cells is not None:
            i, j = CORNER_TILES[self.deal]
            at = np.flatnonzero(self.cells)
            return at | (i << 11 | j) << 22, self.cells[at]
        keys, counts = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _summed(finish):
    """Sums over rows that come in order of deal, handed on as ``finish(deal, keys, counts)`` gives them.

    In the first round a corner tile keeps all counts, other tiles are through and keep frequent ones.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: Sums | None = None
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            keys, counts = sums.total()
            if finish is not _partial or sums.cells is None:
                kept = counts >= LEAST
                keys, counts = keys[kept], counts[kept]
            if len(keys):
                yield finish(sums.deal, keys, counts)

        for batch in batches:
            for deal, salt, keys, counts in rows_of(batch, 20):
                if (deal, salt) != group:
                    if sums:
                        yield from done()
                    sums, group = Sums(deal), (deal, salt)
                sums.add(np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64))
        if sums:
            yield from done()

    return run


def _partial(deal: int, keys, counts) -> pa.RecordBatch:
    columns = [pa.array([deal], pa.int64()), pa.array([0], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, counts))]
    return pa.RecordBatch.from_arrays(columns, names=["deal", "salt", "keys", "counts"])


def _cells(deal: int, keys, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, cell_ids(keys)), pa.array(counts)], names=["left", "right", "n"])


def _frequent(docs: DataFrame, ranks: Ranks, deals: int, triples: bool, finish, ddl: str) -> DataFrame:
    rows = _tally(docs, ranks, deals, triples)
    first = rows.repartition("deal", "salt").sortWithinPartitions("deal", "salt").mapInArrow(_summed(_partial), rows.schema)
    return first.repartition("deal").sortWithinPartitions("deal").mapInArrow(_summed(finish), ddl)


def frequent_pairs(docs: DataFrame, ranks: Ranks, deals: int) -> DataFrame:
    """left, right, n of frequent pairs of word ids."""
    return _frequent(docs, ranks, deals, False, _cells, "left long, right long, n long")


PHRASE_DDL = "lang string, w1 string, w2 string, w3 string, a long"


def _phrase_rows(known: Ranks, ids: list, counts) -> pa.RecordBatch:
    spelled = [known.words.take(pa.array(column)) for column in ids]
    spelled += [pa.nulls(len(counts), pa.string())] * (3 - len(spelled))
    langs = known.langs.take(pa.array(ids[0])).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, *spelled, pa.array(counts)], names=["lang", "w1", "w2", "w3", "a"])


def _spelled(pairs: DataFrame, ranks: Ranks) -> DataFrame:
    """frequent_pairs as words."""
    shared = pairs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, n = (batch.column(i).to_numpy() for i in range(3))
            yield _phrase_rows(shared.value, [left, right], n)

    return pairs.select("left", "right", "n").mapInArrow(run, PHRASE_DDL)


def frequent_triples(docs: DataFrame, ranks: Ranks, deals: int) -> DataFrame:
    """Frequent phrases of three words whose pairs have ids; spelled where they are summed, so a task needs one worker."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def finish(deal: int, keys, counts) -> pa.RecordBatch:
        known = shared.value
        pair, word = cell_ids(keys)
        return _phrase_rows(known, [known.left[pair], known.right[pair], word], counts)

    return _frequent(docs, ranks, deals, True, finish, PHRASE_DDL)


def _other_phrases(docs: DataFrame, ranks: Ranks, words: Bits | None, pairs: Bits | None, triples: bool) -> DataFrame:
    """Phrases with a word or pair that has no id, as plain rows; the bitmaps tell what is frequent without one (None: nothing)."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, words, pairs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known, words, pairs = shared.value
        counts: Counter = Counter()
        frequent: dict[tuple[bytes, bytes], bool] = {}

        def is_frequent(lang: bytes, word: bytes) -> bool:
            if len(frequent) > HELD_WORDS:
                frequent.clear()
            if (lang, word) not in frequent:
                frequent[lang, word] = words is not None and words.has(lang, word)
            return frequent[lang, word]

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*((*key, n) for key, n in counts.items()), strict=True)) if counts else [()] * 5
            counts.clear()
            kinds = [*[pa.binary()] * 4, pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], names=["lang", "w1", "w2", "w3", "a"])

        for batch in batches:
            for lang, raw in rows_of(batch):
                if not raw:
                    continue
                ids, name = known.ids(lang, raw), lang.encode()
                tokens = [t for t in raw.translate(FOLDED).replace(b"\n", b" \n ").split(b" ") if t]
                tokens.append(b"\n")
                word = ids >= 0
                for t in np.flatnonzero(ids == UNKNOWN).tolist():
                    word[t] = is_frequent(name, tokens[t])
                both = word[:-1] & word[1:]
                if triples:
                    paired = known.pairs(ids) >= 0
                    fine = paired.copy()
                    for t in np.flatnonzero(both & ~paired).tolist() if pairs is not None else ():
                        fine[t] = pairs.has(name, tokens[t], tokens[t + 1])
                    for t in np.flatnonzero(fine[:-1] & fine[1:] & ~(paired[:-1] & paired[1:])).tolist():
                        counts[name, tokens[t], tokens[t + 1], tokens[t + 2]] += 1
                else:
                    for t in np.flatnonzero(both & ((ids[:-1] < 0) | (ids[1:] < 0))).tolist():
                        counts[name, tokens[t], tokens[t + 1], None] += 1
                if len(counts) >= HELD_WORDS:
                    yield flushed()
        yield flushed()

    rows = _texts(docs).mapInArrow(run, PHRASE_DDL).groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a"))
    return rows.filter(F.col("a") >= LEAST)


def phrases(docs: DataFrame, most_words: int = WORDS, most_pairs: int = PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n over all words), (lang, word, n of frequent words), (lang, w1, w2, w3, a of frequent phrases; w3 null for two words)."""
    import numpy as np

    words = stored(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= LEAST)
    top, all_words = most_frequent(frequent, most_words)
    ranks = Ranks(top.toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")]))  # bounded by WORDS
    # more words in all, more deals: a deal's sums stay within a worker's memory
    deals = 64 + (words.agg(F.sum("n")).first()[0] or 0) // DEALT
    pairs = stored(frequent_pairs(docs, ranks, deals), "pairs")
    best, all_pairs = most_frequent(pairs, most_pairs)
    held = best.toArrow().sort_by([("n", "descending"), ("left", "ascending"), ("right", "ascending")])  # bounded by PAIRS
    both = Ranks(ranks.table(), (held["left"].to_numpy().astype(np.int64), held["right"].to_numpy().astype(np.int64)))
    twos = _spelled(pairs, ranks)
    other_words = other_pairs = None
    if not all_words:
        other_words = Bits(frequent.join(top.select("lang", "word"), ["lang", "word"], "left_anti"), "lang", "word")
        twos = stored(twos.unionAll(_other_phrases(docs, ranks, other_words, None, False)), "twos")
    found = twos.unionAll(frequent_triples(docs, both, deals))
    if not (all_words and all_pairs):
        # pairs that have ids are told by these; their places in the bitmap are of no use and no harm
        other_pairs = Bits(twos, "lang", "w1", "w2")
        found = found.unionAll(_other_phrases(docs, both, other_words, other_pairs, True))
    return totals, frequent, stored(found, "phrases")


def _score(left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)) in decimals of 38 digits; counts may have 15."""
    return F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")


def collocations(docs: DataFrame, top: int = TOP, most_words: int = WORDS, most_pairs: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words."""
    totals, words, found = phrases(docs, most_words, most_pairs)
    twos, threes = found.filter("w3 is null").drop("w3"), found.filter("w3 is not null")

    def with_word(df: DataFrame, word: str, name: str) -> DataFrame:
        return df.join(words.select("lang", F.col("word").alias(word), F.col("n").alias(name)), ["lang", word])

    def with_pair(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
        return df.join(twos.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(name)), ["lang", first, second])

    cut = with_pair(with_word(with_pair(with_word(threes, "w1", "l1"), "w2", "w3", "r1"), "w3", "r2"), "w1", "w2", "l2")
    cut = cut.withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    # a pair inside a phrase of three words that has at least half of its occurrences goes
    inside = threes.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    longest = inside.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    alone = twos.join(longest, ["lang", "w1", "w2"], "left").filter(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * 50)
    two = with_word(with_word(alone, "w1", "l"), "w2", "r")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = three.unionAll(two).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    best = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
with d as (
    select row_number() over () as id, coalesce(lang, 'und') as lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), pieces as (
    select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d
), split as (
    select row_number() over () as p, lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') as words from pieces
), w as (
    select p, lang, generate_subscripts(words, 1) as i, unnest(words) as w from split
), runs as (
    select lang, w as w1, lead(w, 1) over (partition by p order by i) as w2, lead(w, 2) over (partition by p order by i) as w3 from w
), f1 as (
    select lang, w1, count(*) as n from runs group by lang, w1
), f2 as (
    select lang, w1, w2, count(*) as a from runs where w2 is not null group by lang, w1, w2 having count(*) >= 10
), f3 as (
    select lang, w1, w2, w3, count(*) as a from runs where w3 is not null group by lang, w1, w2, w3 having count(*) >= 10
), cuts as (
    select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 as phrase, 1 as k, t.a, x.n as l, y.a as r
    from f3 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f2 y on y.lang = t.lang and y.w1 = t.w2 and y.w2 = t.w3
    union all
    select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.a, x.a, y.n
    from f3 t join f2 x on x.lang = t.lang and x.w1 = t.w1 and x.w2 = t.w2 join f1 y on y.lang = t.lang and y.w1 = t.w3
    union all
    select t.lang, t.w1 || ' ' || t.w2, 1, t.a, x.n, y.n
    from f2 t join f1 x on x.lang = t.lang and x.w1 = t.w1 join f1 y on y.lang = t.lang and y.w1 = t.w2
    where not exists (
        select 1 from f3 b where b.lang = t.lang and 100 * b.a >= 50 * t.a and (b.w1 = t.w1 and b.w2 = t.w2 or b.w2 = t.w1 and b.w3 = t.w2)
    )
), scored as (
    select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts
), least as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from least
)
select lang, rank, phrase, a, l, r, (select sum(f.n)::bigint from f1 f where f.lang = ranked.lang) as n, score from ranked where rank <= 2000
"""
