"""Merkle manifest of a dataset: nodes with nested intervals of leaf ranks, proofs by containment joins.

Rows are leaves of their tree (one tree for each group, say a language) in order of their ids, and the roots of the
trees are the leaves of one more tree. Every node carries the interval of leaf ranks that it covers. Levels are put
into buckets of ``SPAN``; a group of a bucket is what one node at the bucket's upper edge covers, so it has at most
2^SPAN items and as many nodes, for a tree of any size, and one shuffle deals with ``SPAN`` levels.

* Building goes up: each group makes its nodes, and the uppermost of them are the items of the next bucket.
* Proofs come down: items meet the nodes of their group and the proof of the group's uppermost node. A node whose
  interval contains an item's is its ancestor, and what is left of a parent's interval without the child's is covered
  by the child's siblings.

Rows are ordered by id, null first, then by digest, so repeated rows are leaves side by side and which one is which
doesn't matter. A null tree comes first. An empty table has no nodes and no proofs. Texts of any length are hashed
whole. Only the number of buckets of levels reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landq.llm.common import Rows, rows_of, stored, table, task_number

SPAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE_DDL = "tree string, height int, level int, lo long, hi long, digest binary"
#: What a step of a proof says about the sibling: there is none, it stands before, it stands after.
ALONE, BEFORE, AFTER = 0, 1, 2


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256))


def leaves(docs: DataFrame, copy: dict[str, Column] | None = None, changed: Column | None = None, fields: Iterable[str] = FIELDS, tree: str = "lang", id: str = "doc_id") -> DataFrame:
    """tree, id, leaf and claimed: the digest of a copy of the row with the columns ``copy``, null where it isn't ``changed``."""
    values = {name: F.col(f"`{name}`") for name in fields}
    claimed = F.when(changed, leaf_digest((values | copy).values())) if copy else F.lit(None).cast("binary")
    return docs.select(F.col(f"`{tree}`").cast("string").alias("tree"), F.col(f"`{id}`").alias("id"), leaf_digest(values.values()).alias("leaf"), claimed.alias("claimed"))


def ranked(rows: DataFrame, name: str = "leaves") -> DataFrame:
    """Leaves with lo, hi (both the rank from 0 within the tree) and height of the tree; stored.

    Rows are dealt by range with a salt behind the order, so neither a large tree nor a repeated row meets in one task.
    """
    keys = [F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("claimed"), F.col("_salt")]
    dealt = stored(rows, f"{name}-digests").withColumn("_salt", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    schema = T.StructType([*dealt.schema, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = task_number(), None, -1
        for batch in batches:
            local = []
            for tree in batch.column("tree").to_pylist():
                seen = seen + 1 if tree == last else 0
                last = tree
                local.append(seen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "part", "local"]
            )

    numbered = stored(dealt.mapInArrow(run, schema), f"{name}-order")
    # one row for each tree of a task; a tree has at most as many of them as there are tasks
    totals = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("n").over(whole)
    height = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")
    bases = totals.select(F.col("tree").alias("t"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), height.alias("height"))
    rank = F.col("base") + F.col("local")
    met = numbered.join(bases, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return stored(met.select("tree", "id", "leaf", "claimed", "height", rank.alias("lo"), rank.alias("hi")), name)


def node_digest(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def _bucket(bucket: int) -> Column:
    return F.shiftright("lo", SPAN * (bucket + 1)).alias("bucket")


def _grow(bucket: int):
    """Nodes of one bucket of levels above the items of a group."""

    def run(group: pa.Table) -> pa.Table:
        items = sorted(zip(group["lo"].to_pylist(), group["hi"].to_pylist(), group["digest"].to_pylist(), strict=True))
        tree, height = group["tree"][0].as_py(), group["height"][0].as_py()
        out = []
        for level in range(SPAN * bucket + 1, min(height, SPAN * (bucket + 1)) + 1):
            above, at = [], 0
            while at < len(items):
                run = [items[at]]
                if at + 1 < len(items) and items[at + 1][0] >> level == items[at][0] >> level:
                    run.append(items[at + 1])
                above.append((run[0][0], run[-1][1], node_digest([r[2] for r in run])))
                at += len(run)
            items = above
            out += [(tree, height, level, *node) for node in items]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in NODE_DDL.split(", ")])

    return run


def nodes(ranks: DataFrame) -> list[DataFrame]:
    """The nodes above the leaves, tree, height, level, lo, hi, digest, one stored table for each bucket of levels."""
    highest = ranks.agg(F.max("height")).first()[0] or 0
    items = ranks.select("tree", "height", F.lit(0).alias("level"), "lo", "hi", F.col("leaf").alias("digest"))
    made = []
    for bucket in range(max(1, -(-highest // SPAN))):
        below = items.filter(F.col("height") > SPAN * bucket)
        grown = below.select("*", _bucket(bucket)).groupBy("tree", "bucket").applyInArrow(_grow(bucket), NODE_DDL)
        made.append(stored(grown, "nodes"))
        items = made[-1].filter(F.col("level") == SPAN * (bucket + 1))
    return made


def tree_roots(ranks: DataFrame, made: list[DataFrame]) -> DataFrame:
    """tree, height, digest of each tree's root; a lone leaf is its own."""
    tops = [ranks.filter("height = 0").select("tree", "height", F.col("leaf").alias("digest"))]
    tops += [n.filter(F.col("level") == F.col("height")).select("tree", "height", "digest") for n in made]
    return reduce(DataFrame.unionAll, tops)


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and the steps of a proof lead to."""
    at = 0
    while at < len(proof):
        step, sibling = proof[at], proof[at + 1 : at + 33]
        leaf = node_digest([leaf] if step == ALONE else [sibling, leaf] if step == BEFORE else [leaf, sibling])
        at += 1 if step == ALONE else 33
    return leaf


def siblings(proof: bytes) -> list[bytes]:
    at, found = 0, []
    while at < len(proof):
        if proof[at] != ALONE:
            found.append(proof[at + 1 : at + 33])
        at += 1 if proof[at] == ALONE else 33
    return found


def _attach(bucket: int, id_type: pa.DataType):
    """Proofs of a group's items: nodes whose intervals contain an item's are its ancestors, level by level."""
    names = ["tree", "lo", "id", "digest", "claimed", "proof", "subroot", "root"]
    kinds = [pa.string(), pa.int64(), id_type, *[pa.binary()] * 5]

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        rows: dict[int, list[dict]] = {0: [], 1: [], 2: []}
        for row in group.to_pylist():
            rows[row["kind"]].append(row)
        items = sorted(rows[0], key=lambda r: r["lo"])
        levels = {SPAN * bucket: [(r["lo"], r["hi"], r["digest"]) for r in items]}
        for r in sorted(rows[1], key=lambda r: r["lo"]):
            levels.setdefault(r["level"], []).append((r["lo"], r["hi"], r["digest"]))
        steps: list[list[bytes]] = [[] for _ in items]
        lo, hi = (np.array([r[k] for r in items], np.int64) for k in ("lo", "hi"))
        child, below = np.arange(len(items)), levels[SPAN * bucket]
        for level in sorted(levels)[1:]:
            above = levels[level]
            starts, ends = (np.array([n[k] for n in above], np.int64) for k in (0, 1))
            parent = np.searchsorted(starts, lo, side="right") - 1
            if not ((starts[parent] <= lo) & (hi <= ends[parent])).all():
                raise ValueError("a node is missing")
            for i, (p, c) in enumerate(zip(parent.tolist(), child.tolist(), strict=True)):
                # the parent's interval without the child's: before it, after it, or nothing
                if below[c][0] > above[p][0]:
                    steps[i].append(bytes([BEFORE]) + below[c - 1][2])
                elif below[c][1] < above[p][1]:
                    steps[i].append(bytes([AFTER]) + below[c + 1][2])
                else:
                    steps[i].append(bytes([ALONE]))
            child, below = parent, above
        top = rows[2][0] if rows[2] else {"proof": b"", "subroot": None, "root": None}
        made = [(r["tree"], r["lo"], r["id"], r["digest"], r["claimed"], b"".join(s) + top["proof"], top["subroot"], top["root"]) for r, s in zip(items, steps, strict=True)]
        columns = list(zip(*made, strict=True)) if made else [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def tree_proofs(ranks: DataFrame, made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, id, digest, claimed, proof, subroot, root of each leaf; tops: tree, height, proof, subroot, root of each tree's root."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = ranks.schema["id"].dataType
    nothing = {c: F.lit(None).cast("binary").alias(c) for c in ("digest", "claimed", "proof", "subroot", "root")}
    no_id, no_level = F.lit(None).cast(kind).alias("id"), F.lit(None).cast("int").alias("level")
    shape = T.StructType().add("tree", "string").add("lo", "long").add("id", kind)
    for c in ("digest", "claimed", "proof", "subroot", "root"):
        shape = shape.add(c, "binary")
    found = None
    for bucket in reversed(range(len(made))):
        if bucket:
            own = made[bucket - 1].filter((F.col("level") == SPAN * bucket) & (F.col("height") > SPAN * bucket))
            items = own.select(F.lit(0).alias("kind"), "tree", _bucket(bucket), "level", "lo", "hi", no_id, "digest", *[nothing[c] for c in ("claimed", "proof", "subroot", "root")])
        else:
            items = ranks.select(
                F.lit(0).alias("kind"), "tree", _bucket(0), F.lit(0).alias("level"), "lo", "hi", "id", F.col("leaf").alias("digest"), "claimed", nothing["proof"], nothing["subroot"], nothing["root"]
            )
        inner = made[bucket].select(
            F.lit(1).alias("kind"), "tree", _bucket(bucket), "level", "lo", "hi", no_id, "digest", *[nothing[c] for c in ("claimed", "proof", "subroot", "root")]
        )
        edge = [F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), no_id, nothing["digest"], nothing["claimed"], "proof", "subroot", "root"]
        last = F.greatest(F.lit(0), F.floor((F.col("height") - 1) / SPAN)) == bucket
        upper = tops.filter(last).select(F.lit(2).alias("kind"), "tree", F.lit(0).cast("long").alias("bucket"), no_level, *edge)
        if found is not None:
            upper = upper.unionAll(found.select(F.lit(2).alias("kind"), "tree", F.shiftright("lo", SPAN * (bucket + 1)).alias("bucket"), no_level, *edge))
        rows = items.unionAll(inner).unionAll(upper)
        found = rows.groupBy("tree", "bucket").applyInArrow(_attach(bucket, to_arrow_type(kind)), shape)
        if bucket:
            found = stored(found, "proofs")
    return found.drop("lo")


def proofs(rows: DataFrame) -> DataFrame:
    """id, leaf, claimed, subroot, root, proof of each row of ``leaves``: the steps from the leaf by its tree's root to the root."""
    ranks = ranked(rows)
    made = nodes(ranks)
    roots = stored(tree_roots(ranks, made), "subroots")
    upper = roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("claimed"))
    upper_ranks = ranked(upper, "subroot-leaves")
    upper_made = nodes(upper_ranks)
    whole = tree_roots(upper_ranks, upper_made)
    one = whole.select("tree", "height", F.unhex(F.lit("")).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = tree_proofs(upper_ranks, upper_made, one).select(F.col("id").alias("t"), "proof", F.col("digest").alias("subroot"), "root")
    tops = roots.join(above, F.col("tree").eqNullSafe(F.col("t"))).select("tree", "height", "proof", "subroot", "root")
    return tree_proofs(ranks, made, stored(tops, "tops")).select("id", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "proof")


def checked(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf, else the leaf), verified."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = T.StructType().add("doc_id", found.schema["id"].dataType)
    for name in names[1:-1]:
        schema = schema.add(name, "string")
    schema = schema.add("verified", "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Rows(pa.schema([pa.field("doc_id", batch.schema.field(0).type), *[(n, pa.string()) for n in names[1:-1]], ("verified", pa.bool_())]))
            for id, leaf, claimed, subroot, root, proof in rows_of(batch):
                folded = fold(claimed or leaf, proof)
                out.add((id, leaf.hex(), subroot.hex(), root.hex(), node_digest(siblings(proof)).hex(), folded.hex(), folded == root))
            yield out.take()

    return found.mapInArrow(run, schema)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return checked(proofs(leaves(docs, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tampered)))


OP12_SQL = """
with recursive crc_table as (
    select list(v order by b) as t from (
        select b, list_reduce(list_prepend(b::bigint, [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
            lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end) as v
        from (select unnest(range(256)) as b) r
    ) s
), d as (
    select doc_id, lang, source, n_chars, text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
            string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
            lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1])), 4294967295::bigint) % 7 = 0 as tampered
    from documents, crc_table
), texts as (
    select doc_id, lang, tampered,
        case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
        || case when source is null then '-' else strlen(source) || ':' || source end
        || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
        case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end as size,
        case when n_chars is null then '-' else strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) end as other_size,
        case when text is null then '-' else strlen(text) || ':' || text end as tail
    from d
), leaf as (
    select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first) - 1 as r, sha256(head || size || tail) as leaf,
        sha256(head || case when tampered then other_size else size end || tail) as claimed
    from texts
), sizes as (
    select lang, count(*) as n, row_number() over (order by lang nulls first) - 1 as place from leaf group by lang
), nodes as (
    select place as tree, 0 as level, r as i, n, leaf as h from leaf join sizes on leaf.lang is not distinct from sizes.lang
    union all
    select a.tree, a.level + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
    from nodes a left join nodes b on b.tree = a.tree and b.i = a.i + 1 where a.i % 2 = 0 and a.n > 1
), upper as (
    select 0 as level, tree as i, (select count(*) from sizes) as n, h from nodes where n = 1
    union all
    select a.level + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
    from upper a left join upper b on b.i = a.i + 1 where a.i % 2 = 0 and a.n > 1
), whole as (
    select tree, level, i, n, h from nodes union all select -1, level, i, n, h from upper
), walk as (
    select doc_id, leaf, place as tree, place, 0 as level, r as i, claimed as h, '' as proof from leaf join sizes on leaf.lang is not distinct from sizes.lang
    union all
    select w.doc_id, w.leaf, case when me.n = 1 then -1 else w.tree end, w.place, case when me.n = 1 then 0 else w.level + 1 end,
        case when me.n = 1 then w.place else w.i // 2 end,
        case when me.n = 1 then w.h when w.i % 2 = 1 then sha256(s.h || w.h) else sha256(w.h || coalesce(s.h, '')) end,
        case when me.n = 1 then w.proof else w.proof || coalesce(s.h, '') end
    from walk w join whole me on me.tree = w.tree and me.level = w.level and me.i = w.i
    left join whole s on s.tree = w.tree and s.level = w.level and s.i = xor(w.i, 1)
    where not (w.tree = -1 and me.n = 1)
)
select w.doc_id, w.leaf, t.h as subroot, u.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = u.h as verified
from walk w join nodes t on t.tree = w.place and t.n = 1 join upper u on u.n = 1
join whole e on e.tree = w.tree and e.level = w.level and e.i = w.i where w.tree = -1 and e.n = 1
"""
