"""Hash-chained audit log: append, verify, summarize, list.

A single chain would force one task to write everything. Here each chain (a document, or a bucket of
them) is cut into segments of a fixed number of entries, and a segment starts from a seed of its own, so
no task ever handles more than one segment at a time. The head table is a second chain, over the segments'
last hashes. Changing, dropping or swapping entries breaks a hash; a segment that is gone breaks the link
of the next one; a segment that was rewritten as a whole, or cut off at the end, differs from its head. The
heads of a batch are the leaves of a digest tree, and the roots of the batches form a chain of their own: whoever
holds its last hash can tell whether any head, and so any entry, has changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.functions.hashing import GENESIS, chain_hash, chain_step, payload
from landq.operators import merkle
from landq.operators.ordered import HOT_ROWS, hot_keys, ranked

SEGMENT_ROWS = 100_000


def segment_seed(chain: Column, segment: Column) -> Column:
    """Hash an entry at the start of a segment builds on; the chain's first segment starts at genesis."""
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(
        F.sha2(F.concat_ws(":", chain.cast("string"), segment.cast("string")), 256)
    )


def link_bodies(bodies: Iterable[str], start: str) -> list[str]:
    """The start hash followed by the hash after each body."""
    hashes = [start]
    for body in bodies:
        hashes.append(chain_step(hashes[-1], body))
    return hashes


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks sorted rows once. Only the last hash is held, whatever the length of a chain."""
    place, last = None, ""
    for batch in batches:
        chains, seqs = batch["_chain"].to_pylist(), batch["seq"].to_pylist()
        befores, afters = [], []
        for chain, seq, seed, body in zip(chains, seqs, batch["_seed"].to_pylist(), batch["_body"].to_pylist()):
            if seed is None and place != (chain, seq - 1):
                raise ValueError(f"entry {seq} of chain {chain} does not follow the one before it")
            befores.append(last if seed is None else seed)
            last = chain_step(befores[-1], body)
            afters.append(last)
            place = (chain, seq)
        kept = [i for i, name in enumerate(batch.schema.names) if name not in ("_chain", "_seed", "_body")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + [pa.array(befores, pa.string()), pa.array(afters, pa.string())],
            names=[batch.schema.names[i] for i in kept] + ["previous_hash", "current_hash"],
        )


def append_chain(
    events: DataFrame,
    chain: str,
    order: list[str],
    splits: list[Column],
    hashed: list[str],
    segment_rows: int = SEGMENT_ROWS,
    hot_rows: int = HOT_ROWS,
    heads: DataFrame | None = None,
) -> DataFrame:
    """Adds seq (from 0 per chain), segment, previous_hash and current_hash.

    Every column in ``hashed`` is covered. Rows are shuffled once, by chain, for numbering and linking;
    only when some chain is very long are they shuffled once more, by segment. With the ``heads`` of a stored
    log, chains in it go on where they ended: appending in parts gives what appending at once gives.
    """
    placed = ranked(events, [chain], order, splits, "seq", hot_rows).withColumn("seq", F.col("seq") - 1)
    starts_at, goes_on = F.lit(0), F.lit(None).cast("string")
    columns = placed.columns
    if heads is not None:
        ends = chain_ends(heads, segment_rows)
        placed = placed.join(ends, F.col(chain).cast("string") == ends["_end_chain"], "left")
        starts_at, goes_on = F.coalesce("_next_seq", F.lit(0)), F.col("_last")
    placed = placed.withColumn("seq", F.col("seq") + starts_at).withColumn("_goes_on", F.when(F.col("seq") == starts_at, goes_on))
    placed = placed.select(*columns, "_goes_on")
    placed = placed.withColumn("segment", F.floor(F.col("seq") / segment_rows).cast("long"))
    starts = F.col("seq") % segment_rows == 0
    types = [f for f in placed.schema.fields if f.name != "_goes_on"]
    bodied = placed.withColumns(
        {
            "_chain": F.col(chain).cast("string"),
            "_body": payload(F.col(chain), F.col("seq"), *[F.col(c) for c in hashed]),
            "_seed": F.when(starts, segment_seed(F.col(chain), F.col("segment"))).otherwise(F.col("_goes_on")),
        }
    ).drop("_goes_on")
    if hot_keys(events, [chain], hot_rows) is not None:
        bodied = bodied.repartition(chain, "segment")
    schema = T.StructType(
        [*types, T.StructField("previous_hash", T.StringType()), T.StructField("current_hash", T.StringType())]
    )
    return bodied.sortWithinPartitions(chain, "seq").mapInArrow(_link, schema)


def chain_ends(heads: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Where each chain of a stored log goes on: its next seq and the hash to build on."""
    last = heads.groupBy("chain_id").agg(F.max_by(F.struct("segment", "entries", "last_hash"), "segment").alias("h"))
    return last.select(
        F.col("chain_id").cast("string").alias("_end_chain"),
        (F.col("h.segment") * segment_rows + F.col("h.entries")).alias("_next_seq"),
        F.col("h.last_hash").alias("_last"),
    )


def linked_heads(heads: DataFrame) -> DataFrame:
    """Adds head_hash, the chain over the segments' last hashes; the last one stands for the whole chain.

    A chain has one head for each full segment, so a list of them is short beside the log.
    """
    listed = heads.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("segment", "last_hash", "entries"))).alias("hs"))
    start = F.struct(F.lit(GENESIS).alias("hash"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, h: Column) -> Column:
        now = F.sha2(F.concat_ws(":", acc["hash"], h["segment"].cast("string"), h["last_hash"]), 256)
        return F.struct(now.alias("hash"), F.concat(acc["done"], F.array(now)).alias("done"))

    chained = listed.withColumn("done", F.aggregate("hs", start, step, lambda acc: acc["done"]))
    rows = chained.select("chain_id", F.explode(F.arrays_zip("hs", "done")).alias("x"))
    return rows.select("chain_id", "x.hs.segment", "x.hs.last_hash", "x.hs.entries", F.col("x.done").alias("head_hash"))


def segment_heads(log: DataFrame, chain: str) -> DataFrame:
    """Last hash and size of every segment, kept apart from the log so that a cut-off tail shows."""
    return log.groupBy(F.col(chain).alias("chain_id"), "segment").agg(
        F.max_by("current_hash", "seq").alias("last_hash"), F.count(F.lit(1)).alias("entries")
    )


def verify_chain(log: DataFrame, chain: str, hashed: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """chain, seq, broken: null, 'link' (previous hash does not fit) or 'content' (entry was changed).

    A segment starts from its own seed, so each one is checked on its own: one shuffle by (chain, segment),
    groups of bounded size however long a chain is. Its first entry also needs the last entry of the segment
    before it; a hole inside a segment is reported where it is, and only there.
    """
    segment = F.floor(F.col("seq") / segment_rows).cast("long")
    w = Window.partitionBy(chain, "_segment").orderBy("seq")
    near = log.withColumn("_segment", segment).withColumns(
        {"_before": F.lag("current_hash").over(w), "_place": F.lag("seq").over(w)}
    )
    lasts = log.filter((F.col("seq") + 1) % segment_rows == 0).select(F.col(chain).alias("_c"), (segment + 1).alias("_s"))
    lasts = lasts.distinct().withColumn("_ended", F.lit(True))
    near = near.join(lasts, near[chain].eqNullSafe(lasts["_c"]) & (near["_segment"] == lasts["_s"]), "left")
    # a link to a missing entry is a break too: nothing to compare with is not a match
    complete = (F.col("_segment") == 0) | F.coalesce(F.col("_ended"), F.lit(False))
    first = F.col("seq") % segment_rows == 0
    expected = F.when(first & complete, segment_seed(F.col(chain), F.col("_segment"))).when(
        ~first &
        (F.col("_place") == F.col("seq") - 1), F.col("_before")
    )
    body = payload(F.col(chain), F.col("seq"), *[F.col(c) for c in hashed])
    fits = F.coalesce(F.col("previous_hash") == expected, F.lit(False))
    unchanged = F.coalesce(F.col("current_hash") == chain_hash(F.col("previous_hash"), body), F.lit(False))
    broken = F.when(~fits, "link").when(~unchanged, "content")
    return near.select(F.col(chain), F.col("seq"), broken.alias("broken"), F.col("current_hash"))


def sealed_breaks(log: DataFrame, heads: DataFrame, chain: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """chain_id, seq, broken of the heads that the log does not bear out any more.

    ``missing``: the entry that a head names is gone, from ``seq`` on as far as the segment goes; so is a cut-off tail, a
    segment or a whole chain. ``rewritten``: it has another hash, whatever the log itself says; the segment begins at
    ``seq``. Entries appended since then don't matter, so heads may be older than the log.
    """
    ends = log.select(F.col(chain).alias("_c"), F.col("seq").alias("_at"), F.col("current_hash").alias("_now"))
    last = F.col("segment") * segment_rows + F.col("entries") - 1
    met = heads.join(ends, heads["chain_id"].eqNullSafe(ends["_c"]) & (last == ends["_at"]), "left").filter(~F.col("_now").eqNullSafe(F.col("last_hash")))
    left = log.groupBy(F.col(chain).alias("_l"), F.floor(F.col("seq") / segment_rows).cast("long").alias("_s")).agg(F.max("seq").alias("_max"))
    met = met.join(left, met["chain_id"].eqNullSafe(left["_l"]) & (met["segment"] == left["_s"]), "left")
    start = F.col("segment") * segment_rows
    gone = F.col("_now").isNull()
    seq = F.when(gone & F.col("_max").isNotNull(), F.least(F.col("_max") + 1, last)).otherwise(start)
    return met.select("chain_id", seq.cast("long").alias("seq"), F.when(gone, "missing").otherwise("rewritten").alias("broken"))


def missing_tails(log: DataFrame, heads: DataFrame, chain: str) -> DataFrame:
    """Segments that no longer end as the head table says."""
    now = segment_heads(log, chain).withColumnsRenamed({"last_hash": "_hash", "entries": "_entries"})
    joined = heads.join(now, ["chain_id", "segment"], "left")
    same = F.col("last_hash").eqNullSafe(F.col("_hash")) & F.col("entries").eqNullSafe(F.col("_entries"))
    return joined.filter(~same).select("chain_id", "segment")


def chain_summary(verified: DataFrame, chain: str, sealed: DataFrame | None = None) -> DataFrame:
    """Per chain: valid, blocks, first break and its kind, latest hash.

    With ``sealed`` (from sealed_breaks) what the log itself cannot show counts as well: cut-off tails, rewritten
    segments, and chains that are gone, which come back as rows of no blocks.
    """
    rows = verified.select(chain, "seq", "broken", "current_hash", F.lit(1).alias("_n"))
    if sealed is not None:
        rows = rows.unionAll(sealed.select("chain_id", "seq", "broken", F.lit(None).cast("string"), F.lit(0)))
    bad = F.col("broken").isNotNull()
    return rows.groupBy(chain).agg(
        F.sum("_n").alias("total_blocks"),
        (F.count_if(bad) == 0).alias("chain_valid"),
        F.min(F.when(bad, F.col("seq"))).alias("broken_at"),
        # at one place, what the log itself shows comes first
        F.min_by("broken", F.when(bad, F.struct("seq", (F.col("_n") == 0).alias("_sealed")))).alias("break_kind"),
        F.max_by("current_hash", F.when(F.col("_n") == 1, F.col("seq"))).alias("latest_hash"),
    )


# ---------------------------------------------------------------- seals


def batch_heads(log: DataFrame, chain: str, batch: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """batch, chain_id, segment, last_hash, entries: the heads of the segments that each batch wrote to, as it left them."""
    held = log.groupBy(F.col(batch).alias("batch"), F.col(chain).alias("chain_id"), "segment").agg(
        F.max_by("current_hash", "seq").alias("last_hash"), F.max("seq").alias("_seq")
    )
    return held.select("batch", "chain_id", "segment", "last_hash", (F.col("_seq") - F.col("segment") * segment_rows + 1).alias("entries"))


def head_leaf() -> Column:
    return merkle.leaf_hash(F.col("chain_id"), F.col("segment"), F.col("entries"), F.col("last_hash"))


def placed_heads(heads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds pos, a head's place in its batch's tree: by the hash of the chain's name, which spreads them, then by segment."""
    named = heads.withColumn("_h", F.sha2(F.col("chain_id").cast("string"), 256))
    order, splits = ["_h", "chain_id", "segment"], [F.substring("_h", 1, 3)]
    return ranked(named, ["batch"], order, splits, "pos", hot_rows).withColumn("pos", F.col("pos") - 1).drop("_h")


def sealed_tree(heads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes of the digest trees over the heads of each batch, one tree for a batch."""
    placed = placed_heads(heads, hot_rows)
    return merkle.tree_nodes(placed.select(F.col("batch").alias("tree"), "pos", head_leaf().alias("digest")))


def batch_seals(nodes: DataFrame) -> DataFrame:
    """batch, heads, root and the hash chain over the roots; its last hash stands for the whole log.

    One row for each batch; kept where the log's writers cannot reach, it shows any change to log and heads.
    """
    sizes = nodes.filter("level = 0").groupBy("tree").agg(F.count(F.lit(1)).alias("heads"))
    listed = merkle.roots(nodes).join(sizes, "tree").select(F.lit("seals").alias("log"), F.col("tree").alias("batch"), "heads", "root")
    return append_chain(listed, "log", ["batch"], [F.col("batch")], ["batch", "heads", "root"]).drop("log", "segment")


def seal_breaks(heads: DataFrame, seals: DataFrame) -> DataFrame:
    """batch, valid: whether the heads that are presented give the root that was sealed."""
    now = merkle.roots(sealed_tree(heads)).select(F.col("tree").alias("batch"), F.col("root").alias("_now"))
    return seals.join(now, "batch", "left").select("batch", F.col("root").eqNullSafe(F.col("_now")).alias("valid"))


def head_proofs(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """batch, chain_id, segment, digest, proof: enough to show one head to somebody who holds the batch's root alone."""
    found = merkle.proofs(nodes).withColumnRenamed("tree", "batch")
    return placed_heads(heads).select("batch", "chain_id", "segment", "pos").join(found, ["batch", "pos"]).drop("pos")
