"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every distinct shingle set is one node, so copies of a text, a hot group of any size, cost one row. A node stands in
several sorted orders of its signature. In an order, a region holds the nodes that share the first ``DEPTH`` values. In a
small region all nodes are candidates of each other; in a larger one depth adapts: candidates are the next neighbours in
the sorted order, those with the longest common prefixes. Two sets of similarity .8 share a region in one of 24 orders
but for a chance of 3 in a million.

What neighbours leave open is settled exactly: in a crowded region whose nodes are not all in one component yet, every two
nodes of different components are compared. Its nodes are dealt into blocks, and pairs of blocks into tasks; sketches rule
out most pairs, by a bound that no similar pair exceeds, and full sets decide on the others. Two nodes of the region's
largest component need no comparison, so a group that is one component but for a few nodes costs one more row for each node.

The orders are sorted by range, so a region of any size spreads over tasks; only rows at the edges of tasks are looked at
again. Candidates are confirmed on full sets in two rounds: first the best partner of every node, then whatever still joins
different components, so a large group costs a few confirmations for each node and not for each pair. Crowded regions come last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.llm.common import Rows, per_worker, rows_of, stored, table
from landq.llm.components import components
from landq.llm.vocabulary import Kept

TREES = 24
DEPTH = 4
#: Nodes of a region up to which all are candidates of each other; neighbours on either side that count in larger ones.
SMALL_REGION = 8
NEIGHBOURS = 2
#: Nodes of a block of a crowded region, about; bits of a sketch; parts into which the rows of a region are dealt for joins.
BLOCK = 128
SKETCH_BITS = (256, 32_768)
SALTS = 32
WORDS, PERCENT = 5, 80
KEPT_WORDS = 400_000
SET_DDL = "text_id binary, n_shingles long, node binary, labels array<struct<prefix:long,deep:long>>"


class Shingles:
    """Sets of word shingles as sorted distinct 64-bit hashes, and their signatures."""

    def __init__(self, words: int):
        import numpy as np
        import xxhash

        rng = np.random.default_rng(11)
        self.size, self.np, self.digest = words, np, xxhash.xxh3_128_digest
        self.factors = [np.uint64(x) for x in rng.integers(1, 1 << 63, words, dtype=np.uint64) * 2 + 1]
        self.multipliers = (rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * 2 + 1)[:, None]
        self.tree_factors = rng.integers(1, 1 << 63, DEPTH, dtype=np.uint64) * 2 + 1
        self.known = Kept(xxhash.xxh3_64_intdigest, KEPT_WORDS)

    def mixed(self, h):
        np = self.np
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x9FB21C651E98DF25)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def of(self, text: str):
        """Sorted distinct shingle hashes; with fewer words than a shingle has, one of all of them; none without words."""
        np = self.np
        words = text.encode().lower().split()  # bytes: A-Z only, and exactly the ASCII white space
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        size = min(n, self.size)
        h = np.full(n - size + 1, size if n < self.size else 0, np.uint64)
        for i in range(size):
            h += self.mixed(w[i : n - size + 1 + i]) * self.factors[i]
        return np.unique(self.mixed(h))

    def labels(self, hashes) -> list[tuple[int, int]]:
        """(prefix, deep) for each order: a hash of the first values, and the next values as one sortable number."""
        np = self.np
        least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 512):
            part = hashes[at : at + 512] * self.multipliers
            part ^= part >> np.uint64(33)
            np.minimum(least, part.min(axis=1), out=least)
        least = self.mixed(least).reshape(TREES, DEPTH)
        prefix = (least * self.tree_factors).sum(axis=1, dtype=np.uint64).view(np.int64)
        top = np.roll(least, -1, axis=0) >> np.uint64(48)
        deep = np.zeros(TREES, np.uint64)
        for i in range(DEPTH):
            deep = (deep << np.uint64(16)) | top[:, i]
        return list(zip(prefix.tolist(), deep.view(np.int64).tolist(), strict=True))


def shingles(words: int) -> Shingles:
    return per_worker(("shingles", words), lambda: Shingles(words))


def described(docs: DataFrame, words: int) -> DataFrame:
    """One row for each row of docs (text_id, text): n_shingles, node (digest of the set; null if empty), labels."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shingles(words)
        label = pa.list_(pa.struct([("prefix", pa.int64()), ("deep", pa.int64())]))
        out = Rows(pa.schema([("text_id", pa.binary()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("labels", label)]))
        for batch in batches:
            for text_id, text in rows_of(batch):
                found = made.of(text)
                n = len(found)
                labels = [{"prefix": p, "deep": d} for p, d in made.labels(found)] if n else None
                out.add((text_id, n, made.digest(found.tobytes()) if n else None, labels), TREES * 16)
                if out.full():
                    yield out.take()
        yield out.take()

    return docs.mapInArrow(run, SET_DDL)


def _neighbours(edges_only: bool):
    """Candidate pairs in rows that come sorted by tree, prefix, deep; with edge rows if the order goes on in other tasks.

    Members of crowded regions come as rows without b and deep. A region that goes on in other tasks shows up to
    ``SMALL_REGION`` rows of each part among the edge rows, so that it is crowded there if it is not within a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["a", "b", "tree", "prefix", "deep", "n"]
        held: list[pa.RecordBatch] = []
        count = 0

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            tree, prefix, size = (rows.column(c).to_numpy() for c in ("tree", "prefix", "n"))
            node = rows.column("node").combine_chunks()
            n = len(tree)
            new = np.ones(n, bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])
            region = np.cumsum(new) - 1
            members = np.bincount(region, minlength=1)[region] if n else np.zeros(0, int)
            left, right = [], []
            for k in range(1, min(SMALL_REGION, n)):
                i = np.flatnonzero((region[:-k] == region[k:]) & ((members[:-k] <= SMALL_REGION) | (k <= NEIGHBOURS)))
                a, b = size[i], size[i + k]
                i = i[100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)]  # else the sizes rule a link out
                left.append(i)
                right.append(i + k)
            left = np.concatenate(left) if left else np.zeros(0, int)
            right = np.concatenate(right) if right else np.zeros(0, int)
            none = pa.nulls(len(left), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [node.take(pa.array(left)), node.take(pa.array(right)), none.cast(pa.int32()), none, none, none], names=names
            )
            many = rows.filter(pa.array(members > SMALL_REGION)).combine_chunks()
            for part in many.select(["node", "tree", "prefix"]).to_batches():
                a, tree, prefix = part.columns
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([a, pa.nulls(len(a), pa.binary()), tree, prefix, none, none], names=names)

        def edge(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks().to_batches()[0] if rows.num_rows else rows.schema.empty_table().to_batches()
            columns = [rows.column(c) for c in ("node", "tree", "prefix", "deep", "n")]
            return pa.RecordBatch.from_arrays([columns[0], pa.nulls(len(columns[0]), pa.binary()), *columns[1:]], names=names)

        width, first, before = SMALL_REGION, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= 200_000:
                rows = pa.Table.from_batches(held)
                if first and not edges_only:
                    yield edge(rows.slice(0, width))
                first = False
                yield from pairs(rows)
                held = rows.slice(max(0, rows.num_rows - width)).to_batches()
                count = 0
        if held:
            rows = pa.Table.from_batches(held)
            if first and not edges_only:
                yield edge(rows.slice(0, width))
            yield from pairs(rows)
            if not edges_only:
                yield edge(rows.slice(max(0, rows.num_rows - width)))

    return run


PAIR_DDL = "a binary, b binary, tree int, prefix long, deep long, n long"


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs (a < b) of nodes with the number of times they met; members of crowded regions: tree, prefix, node).

    nodes: node, n_shingles, labels.
    """
    rows = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode("labels").alias("tree", "label"))
    rows = rows.select("tree", "label.prefix", "label.deep", "node", "n")
    order = ["tree", "prefix", "deep", "node"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(_neighbours(False), PAIR_DDL), "neighbours")
    edges = found.filter("b is null and deep is not null").select("tree", "prefix", "deep", F.col("a").alias("node"), "n").distinct()
    across = edges.repartition("tree").sortWithinPartitions(*order).mapInArrow(_neighbours(True), PAIR_DDL)
    both = found.filter("b is not null or deep is null").unionAll(stored(across, "neighbours-across"))
    pairs = both.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b")
    crowded = both.filter("b is null").select("tree", "prefix", F.col("a").alias("node")).distinct()
    return pairs.groupBy("a", "b").agg(F.count("*").alias("votes")), crowded


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            if _similar(np, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; sets: node, hashes."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_confirmed, "a binary, b binary")


def _similar(np, x, y) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _joins(rows: list[tuple]) -> list[tuple]:
    """Pairs of roots that links between two blocks join, or within one; rows: block, root, hashes.

    Bits of a sketch are parities of the number of hashes that fall there, so sketches differ in no more bits than sets
    differ in members; similar sets of p and q members differ in no more than (p + q) * (100 - PERCENT) / (100 + PERCENT).
    """
    import numpy as np

    rows.sort(key=lambda row: row[0])
    block = np.array([row[0] for row in rows])
    roots, group = np.unique(np.array([row[1] for row in rows], object), return_inverse=True)
    if len(roots) < 2:
        return []
    sets = [np.frombuffer(row[2], np.uint64) for row in rows]
    size = np.array([len(x) for x in sets])
    bits = min(max(SKETCH_BITS[0], 1 << int(2 * size.max() - 1).bit_length()), SKETCH_BITS[1])
    sketches = np.empty((len(rows), bits // 64), np.uint64)
    for i, x in enumerate(sets):
        odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        sketches[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    group, found = group.copy(), []
    other = int(np.searchsorted(block, block[-1]))  # the second block's first row
    for i in range(other if other else len(rows)):
        j = np.arange(max(i + 1, other), len(rows))
        p, q = size[i], size[j]
        j = j[(group[j] != group[i]) & (100 * np.minimum(p, q) >= PERCENT * np.maximum(p, q))]
        apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        j = j[(100 + PERCENT) * apart <= (100 - PERCENT) * (p + size[j])]
        for k in j.tolist():
            if group[k] != group[i] and _similar(np, sets[i], sets[k]):
                found.append((rows[i][1], rows[k][1]))
                group[group == group[k]] = group[i]
    return found


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined roots of rows that come sorted by their two blocks: tree, prefix, low, high, block, root, hashes."""
    out = Rows(pa.schema([("x", pa.binary()), ("y", pa.binary())]))
    now, held = None, []
    for batch in batches:
        for *key, block, root, hashes in rows_of(batch):
            if key != now:
                for link in _joins(held) if held else ():
                    out.add(link)
                now, held = key, []
            held.append((block, root, hashes))
            if out.full():
                yield out.take()
    for link in _joins(held) if held else ():
        out.add(link)
    yield out.take()


def settle(crowded: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of roots with similar members in a crowded region; roots: node, root; sets: node, hashes."""
    region = ["tree", "prefix"]
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("_salt")
    members = crowded.join(roots, "node", "left").select(*region, "node", F.coalesce("root", "node").alias("root"), salt)
    members = stored(members, "crowded")
    parts = members.groupBy(*region, "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy(*region).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    # blocks of the largest component come after those of the others
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    still = sizes.filter("most.n < n").select(
        *region, F.col("most.root").alias("_most"), blocks(F.col("n") - F.col("most.n")).alias("_others"), blocks(F.col("most.n")).alias("_own")
    )
    still = stored(still, "open-regions").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    most = F.col("root") == F.col("_most")
    place = F.xxhash64(F.lit(1), "node")
    dealt = members.join(still, [*region, "_salt"]).select(
        *region, "node", "root",
        F.when(most, F.col("_others") + F.pmod(place, "_own")).otherwise(F.pmod(place, "_others")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.when(most, F.col("_others") - 1).otherwise(F.col("_others") + F.col("_own") - 1))).alias("_with"),
    )
    unit = [*region, "low", "high"]
    dealt = dealt.select(*region, F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"), "block", "root", "node")
    full = dealt.join(sets, "node").select(*unit, "block", "root", "hashes")
    return full.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_settled, "x binary, y binary").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, hashes for the wanted text_ids; of copies of one text, which come in a row, one counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = shingles(words), None
        out = Rows(pa.schema([("node", pa.binary()), ("hashes", pa.binary())]))
        for batch in batches:
            for text_id, text, node in rows_of(batch):
                if text_id != last:
                    found = made.of(text).tobytes()
                    out.add((node, found), len(found))
                last = text_id
                if out.full():
                    yield out.take()
        yield out.take()

    joined = docs.join(wanted, "text_id").select("text_id", "text", "node")
    return joined.mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(per row of docs: doc_id, text_id, n_shingles, node; per node: node, component_id).

    Words are runs of anything but ASCII white space, A-Z in lower case; whole texts count. With fewer words than a
    shingle has, their sequence is the only shingle; null and empty texts and those without words have an empty set,
    node null, and link with nothing. component_id is the smallest doc_id of the component, null if all are null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_id"), text.alias("text"))
    texts = named.select("text_id", "text")
    facts = stored(described(texts, words).dropDuplicates(["text_id"]), "signatures")
    rows = named.select("doc_id", "text_id").join(facts.select("text_id", "n_shingles", "node"), "text_id")
    rows = stored(rows, "nodes")
    least = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = facts.filter("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")
    )
    pairs, crowded = candidates(nodes)
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(crowded.select("node")).distinct()
    wanted = wanted.join(facts.groupBy("node").agg(F.min("text_id").alias("text_id")), "node")
    sets = stored(full_sets(texts, wanted, words), "sets")
    # first round: the best partner of each node
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "votes")
    best = ends.groupBy("node").agg(F.max(F.struct("votes", "a", "b")).alias("best"))
    first = stored(confirm(best.select("best.a", "best.b").distinct(), sets), "first-links")
    roots = stored(components(first), "first-roots")
    # second round: pairs that would still join two components
    known = roots.select("node", "root")
    a, b = known.toDF("a", "root_a"), known.toDF("b", "root_b")
    rest = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    rest = rest.select("a", "b", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb")).filter("ra != rb")
    rest = rest.join(first, ["a", "b"], "left_anti")
    links = first.unionAll(confirm(rest.select("a", "b"), sets))
    final = stored(components(links), "roots")
    joined = least.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # last: crowded regions with several components
    more = stored(settle(crowded, final, sets), "settled")
    if not more.isEmpty():
        merged = components(more).select(F.col("node").alias("root"), F.col("root").alias("_top"))
        joined = joined.join(merged, "root", "left").withColumn("root", F.coalesce("_top", "root")).drop("_top")
    # nodes on their own know their component; those of a large one meet its smallest doc_id in several tasks
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    smallest = smallest.select("root", "component_id", salts.alias("_salt"))
    dealt = joined.filter("root is not null").withColumn("_salt", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(SALTS)).cast("int"))
    member = dealt.join(smallest, ["root", "_salt"], "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows, member


def with_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id, kept for every row; kept: doc_id is the component's smallest."""
    rows, member = near_duplicates(docs, words)
    joined = rows.join(member, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Documents without near-duplicates: of each component the rows with the smallest doc_id stay, whole.

    Rows with equal doc_id and text are one document, of which one row stays. Rows without words stay, all of them.
    """
    marked = with_components(docs, words).filter("kept").groupBy("doc_id", "text_id")
    marked = marked.agg((F.max("n_shingles") > 0).alias("some"), F.count("*").alias("rows"))
    marked = marked.select(F.col("doc_id").alias("d"), F.col("text_id").alias("t"), (F.col("some") & (F.col("rows") > 1)).alias("again"))
    # the row travels in one column, so that its names don't meet those of the other side
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    known = whole.withColumn("id", F.unhex(F.md5(text.cast("binary"))))
    same = known["row.doc_id"].eqNullSafe(marked["d"]) & (known["id"] == marked["t"])
    once = known.join(marked.filter("not again"), same).select("row")
    again = known.join(marked.filter("again"), same).dropDuplicates(["d", "t"]).select("row")
    return once.unionAll(again).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_components(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as shingle from d
), n as (
    select doc_id, count(*) as n from s group by doc_id
), links as (
    select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
    join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))
), near as (
    select a, b from links union all select b, a from links
), reach(a, b) as (
    select doc_id, doc_id from d union select reach.a, near.b from reach join near on near.a = reach.b
), least as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on n.doc_id = d.doc_id join least on least.doc_id = d.doc_id
"""
