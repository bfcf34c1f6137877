"""Similar names among all names of an archive, without a row for every two of them.

Names are compared as sets of classes: spellings that mean the same in Latin letters with sorted words are one class.
Two classes are linked if the ratio of their texts reaches a cutoff. The ratio is 200 * common / (la + lb), where
``common`` is the length of the longest common subsequence, so linked texts have at least cutoff * (la + lb) / 200
characters in common, counted with repeats, and their lengths differ by a bounded factor.

Short names have most of their characters in common by chance, so what meets under any shared key grows with the square
of the archive. Texts are therefore dealt in blocks of like length, blocks meet whose lengths allow a link, and a task
compares two blocks in memory (``landq.functions.likeness``). Only links leave the task: shuffles hold each text once for
each block it meets, never a pair. All pairs of like length are looked at, so the time grows with the square of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.functions.likeness import Meeting
from landq.functions.text import round_to, sorted_words, transliterate
from landq.operators.normalize import SAME_NAME
from landq.session import written

#: Bits of a word that stand for numbered characters; frequent ones have a bit of their own.
RANKED = 58
#: Texts of a block, on average, and how many times as many where there would be more than so many blocks.
PART = 16_000
GROWN, BLOCKS = 4, 16
#: Characters of a block, which bound what a task holds where texts are long.
LETTERS = 4_000_000
#: Lengths from here on are one in the list of lengths, by which blocks are made.
LONGEST = 1000
#: Tasks for the comparison of blocks, at most.
TASKS = 2000


def name_classes(names: DataFrame, column: str) -> DataFrame:
    """name, class of each distinct name; the class is its Latin lower-case form with sorted words."""
    # written, since a later distinct over the classes makes the optimizer drop this one, and all rows would be spelled
    distinct = written(names.select(F.col(column).alias("name")).filter("name is not null").distinct(), "names")
    return distinct.select("name", sorted_words(F.lower(transliterate(F.col("name")))).alias("class"))


def described(classes: DataFrame) -> DataFrame:
    """id, class and n (length) of each distinct class that is not empty."""
    distinct = classes.select("class").distinct().filter(F.length("class") > 0)
    return written(distinct.select(F.monotonically_increasing_id().alias("id"), "class", F.length("class").alias("n")), "described-classes")


def _blocks(lengths: list[tuple[int, int]], cutoff: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """length, first block of its band, blocks of the band, first and last block that they meet; and how many blocks there are.

    ``lengths`` are (length, texts) in order. Lengths are put together in a band until it fills a block; a band of more is
    dealt in several blocks. Blocks are numbered by length, so those that one meets are a range.
    """
    part = max(PART, min(GROWN * PART, sum(texts for _, texts in lengths) // BLOCKS))
    room = lambda length: max(1, min(part, LETTERS // length))
    bands: list[list] = []  # [lengths, texts]
    for length, texts in lengths:
        if not bands or bands[-1][1] + texts > room(length):
            bands.append([[], 0])
        bands[-1][0].append(length)
        bands[-1][1] += texts
    parts = [-(-texts // room(ls[-1])) for ls, texts in bands]
    at = [sum(parts[:i]) for i in range(len(bands))]
    # the longest partner of a band's longest text; the last length stands for all above it
    most = [float("inf") if ls[-1] >= LONGEST else ls[-1] * (200 - cutoff) // cutoff for ls, _ in bands]
    listed = []
    for i, (ls, _) in enumerate(bands):
        first = next(at[j] for j in range(i + 1) if ls[0] <= most[j])
        last = max(at[j] + parts[j] - 1 for j in range(i, len(bands)) if bands[j][0][0] <= most[i])
        listed += [(length, at[i], parts[i], first, last) for length in ls]
    return listed, sum(parts)


def _met(texts: DataFrame, cutoff: int) -> DataFrame:
    """The texts once for each block that theirs meets: pair, side (0: of the block of shorter ones, 1: of the other one, 2: of
    a block that meets itself), id and class; rows of a pair stand together."""
    length = F.least("n", F.lit(LONGEST))
    counts = texts.groupBy(length.alias("length")).count().orderBy("length").collect()
    listed, blocks = _blocks([(r["length"], r["count"]) for r in counts], cutoff)
    bands = texts.sparkSession.createDataFrame(listed, "length int, at int, parts int, first int, last int")
    dealt = texts.withColumn("length", length).join(F.broadcast(bands), "length")
    dealt = dealt.withColumn("block", F.col("at") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence("first", "last")))
    pair = F.least("block", "other").cast("long") * blocks + F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int"))
    sided = other.select(pair.alias("pair"), side.alias("side"), "id", "class")
    # a pair has a task of its own as far as there are so many
    tasks = max(1, min(blocks * blocks, TASKS))
    return sided.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("pair", "side")


def _meetings(batches: Iterator[pd.DataFrame], cutoff: int, bits: int) -> Iterator[tuple[pd.DataFrame, Meeting]]:
    """The rows of each pair of blocks, and what meets; a block may have no texts."""

    def met(kept: list[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Meeting]]:
        rows = pd.concat(kept, ignore_index=True)
        shorts, longs, both = (np.flatnonzero(rows["side"].to_numpy() == side) for side in (0, 1, 2))
        if len(both) or (len(shorts) and len(longs)):
            classes = rows["class"].to_numpy(dtype=object)
            yield rows, Meeting(classes, both, None, cutoff, bits) if len(both) else Meeting(classes, shorts, longs, cutoff, bits)

    kept: list[pd.DataFrame] = []
    for batch in batches:
        for pair, rows in batch.groupby("pair", sort=False):
            if kept and kept[0]["pair"].iat[0] != pair:
                yield from met(kept)
                kept = []
            kept.append(rows)
    if kept:
        yield from met(kept)


def candidates(texts: DataFrame, cutoff: int) -> DataFrame:
    """Distinct pairs (short, long) of ids whose length and common characters allow a link."""
    bits = RANKED

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, meeting in _meetings(batches, cutoff, bits):
            ids = rows["id"].to_numpy()
            for a, b in meeting.candidates():
                yield pd.DataFrame({"short": ids[a], "long": ids[b]})

    return _met(texts, cutoff).mapInPandas(pairs, "short long, long long")


def _compare(cutoff: int, bits: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, meeting in _meetings(batches, cutoff, bits):
            classes = rows["class"].to_numpy(dtype=object)
            for a, b, scores in meeting.links():
                if len(a):
                    yield pd.DataFrame({"a": classes[a], "b": classes[b], "score": scores})

    return compare


def class_links(classes: DataFrame, cutoff: float = SAME_NAME) -> DataFrame:
    """a, b (classes, a before b), name_score of all linked classes. classes: class, of any number of rows.

    ``cutoff`` is a whole number above 0 and below 100; null classes take no part, the empty one is linked with none.
    """
    whole = int(cutoff)
    if whole != cutoff or not 0 < whole < 100:
        raise ValueError("the cutoff is a whole number between 1 and 99")
    linked = _met(described(classes), whole).drop("id").mapInPandas(_compare(whole, RANKED), "a string, b string, score double")
    return linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), round_to(F.col("score") / 100.0, 2).alias("name_score"))
