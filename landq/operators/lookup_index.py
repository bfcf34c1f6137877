"""Stored indexes for an archive that is looked up often: substrings by pieces of three characters, pages by their place.

Both are Parquet tables in the shared folder. What a lookup reads depends on what it asks for: the index tables are
sorted, so filters on their keys skip files and row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
#: Pieces of a term whose lists are read, the rarest ones, and ids that are looked up by a list of them.
LISTS, LISTED = 3, 10_000
#: Entries of lists that a task sorts or counts; compressed sizes, by which Spark would deal them, tell little about memory.
DEALT = 1_000_000
#: Version 2 pages carry delta encodings: sorted ids take a few bits each.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.enable.dictionary#id": "false",
    "compression": "zstd",
}


def _tasks(entries: int) -> int:
    return max(1, -(-entries // DEALT))


def _grams(text: Column) -> Column:
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - GRAM + 1)), lambda at: F.substring(text, at, F.lit(GRAM)))
    return F.when(n >= GRAM, pieces).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- substrings


def build_search_index(df: DataFrame, id_column: str, columns: list[str], path: str) -> None:
    """Write ``path``/texts (id, lower-case texts), ``path``/lists (piece, id) and ``path``/sizes (piece, n).

    Lists are dealt by range of piece and id, so a piece that a third of all rows have fills several files, not one task.
    """
    texts = F.array_compact(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]))
    rows = df.select(F.col(id_column).alias("id"), texts.alias("texts"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.options(**LAYOUT).parquet(f"{path}/texts")
    rows = df.sparkSession.read.parquet(f"{path}/texts")
    pieces = rows.select("id", F.explode(F.array_distinct(F.flatten(F.transform("texts", _grams)))).alias("piece"))
    # a text has at most as many pieces as characters
    most = rows.agg(F.sum(F.length(F.array_join("texts", "")))).first()[0] or 0
    lists = pieces.repartitionByRange(_tasks(most), "piece", "id").sortWithinPartitions("piece", "id")
    lists.write.options(**LAYOUT).parquet(f"{path}/lists")
    sizes = df.sparkSession.read.parquet(f"{path}/lists").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    sizes.repartitionByRange("piece").sortWithinPartitions("piece").write.options(**LAYOUT).parquet(f"{path}/sizes")


def search(spark: SparkSession, path: str, term: str) -> DataFrame:
    """id of the rows that have the term in one of their texts, upper and lower case alike.

    Ids in the lists of the term's rarest pieces are looked at; a term of fewer than three characters, the empty one
    included, has no piece and needs all texts.
    """
    term = term.lower()
    texts = spark.read.parquet(f"{path}/texts")
    hit = F.exists("texts", lambda t: t.contains(term))
    pieces = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    if not pieces:
        return texts.filter(hit).select("id")
    sizes = spark.read.parquet(f"{path}/sizes").filter(F.col("piece").isin(pieces)).collect()  # one row for each piece
    if len(sizes) < len(pieces):
        return texts.select("id").limit(0)
    rarest = sorted((r["n"], r["piece"]) for r in sizes)[:LISTS]
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("piece").isin([p for _, p in rarest]))
    lists = lists.repartition(_tasks(sum(n for n, _ in rarest)), "id")
    shared = lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rarest)).select("id")
    if rarest[0][0] <= LISTED:
        # few enough for a filter that the texts' files and row groups can be skipped by
        found = texts.filter(F.col("id").isin([r["id"] for r in shared.collect()]))
    else:
        found = texts.join(shared, "id", "left_semi")
    return found.filter(hit).select("id")


# ---------------------------------------------------------------- pages


def build_page_index(df: DataFrame, newest: str, id_column: str, path: str, by: list[str] | None = None, parts: int | None = None) -> None:
    """Write ``path``/rows, in order of page (newest first, then id) and cut into parts, and ``path``/parts, their places.

    ``by`` names columns of which every page asks for one value each. A part is what one task of the ordering wrote; how
    many there are follows from the size of the rows unless ``parts`` says so.
    """
    by = by or []
    order = [*[F.col(c).asc() for c in by], F.col(newest).desc(), F.col(id_column).asc()]
    parted = df.repartitionByRange(*([parts] if parts else []), *order).withColumn("part", F.spark_partition_id())
    df.limit(0).write.parquet(f"{path}/rows/part=-1")  # has the columns, even of a table without rows
    parted.sortWithinPartitions("part", *order).write.mode("append").partitionBy("part").parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    # a row for each part and kind of page
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def page(spark: SparkSession, path: str, newest: str, id_column: str, offset: int, limit: int, **equal: object) -> DataFrame:
    """The rows from ``offset`` on, ``limit`` of them, of those equal to the given values: reads the parts they stand in."""
    same = F.lit(True)
    for column, value in equal.items():
        same = same & (F.col(column) == F.lit(value))
    inside = (F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset)
    parts = spark.read.parquet(f"{path}/parts").filter(same & inside).select("part", "start").collect()  # those of one page
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin([r["part"] for r in parts])).filter(same).drop("part")
    if not parts:
        return rows.limit(0)
    return rows.orderBy(F.desc(newest), F.asc(id_column)).offset(offset - min(r["start"] for r in parts)).limit(limit)
