"""Digest trees: nodes of many trees at once, their roots, and proofs of logarithmic length.

A leaf has a position from 0 in its tree. Two neighbours make a node, a last one without a neighbour moves up as it
is. Groups of 2^SPAN neighbours make SPAN levels in one shuffle, so neither a large tree nor many small ones meet in
one task, and a tree of a hundred million leaves takes four rounds. Leaves and nodes are hashed under different
prefixes: a node cannot be passed off as a leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.hashing import payload
from landq.session import written

SPAN = 8
NODE_COLUMNS = ["tree", "height", "level", "pos", "digest"]


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(F.lit("leaf:"), payload(*columns)), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node:"), left, right), 256)


def _upper(digests: Column) -> Column:
    """The level above an array of digests."""

    def node(i: Column) -> Column:
        left, right = F.get(digests, 2 * i), F.get(digests, 2 * i + 1)
        return F.when(right.isNull(), left).otherwise(node_hash(left, right))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / 2).cast("int")), node)


def _levels(digests: Column) -> Column:
    """All levels over an array of digests, itself first."""
    steps = F.sequence(F.lit(1), F.lit(SPAN))
    return F.aggregate(steps, F.array(digests), lambda acc, _: F.concat(acc, F.array(_upper(F.element_at(acc, -1)))))


def height_of(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0).cast("int")


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """tree, height, level (0: leaves), pos, digest of all nodes; leaves: tree, pos (dense from 0), digest."""
    sizes = leaves.groupBy("tree").agg(height_of(F.max("pos") + 1).alias("height"))
    level = written(leaves.join(sizes, "tree").select("tree", "height", F.lit(0).alias("level"), F.col("pos").cast("long").alias("pos"), "digest"), "leaves")
    highest = level.agg(F.max("height")).first()[0] or 0
    made = [level]
    for base in range(0, highest, SPAN):
        inner = level.filter(F.col("height") > base)
        group = F.shiftright("pos", SPAN).alias("group")
        held = inner.groupBy("tree", "height", group).agg(F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("digests"))
        lists = held.select("tree", "height", "group", F.posexplode(_levels(F.col("digests"))).alias("up", "above"))
        lists = lists.filter((F.col("up") > 0) & (F.col("up") + base <= F.col("height")))
        nodes = lists.select("tree", "height", "group", "up", F.posexplode("above").alias("at", "digest"))
        place = F.expr(f"shiftleft(group, {SPAN} - up) + at")
        made.append(written(nodes.select("tree", "height", (F.col("up") + base).alias("level"), place.alias("pos"), "digest"), "nodes"))
        level = made[-1].filter(F.col("level") == base + SPAN)
    return reduce(DataFrame.unionAll, made)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("level") == F.col("height")).select("tree", F.col("digest").alias("root"))


def proofs(nodes: DataFrame) -> DataFrame:
    """tree, pos, digest of each leaf and its proof: the siblings from the leaf up, and whether they stand to the left."""
    leaves = nodes.filter(F.col("level") == 0)
    steps = leaves.filter(F.col("height") > 0).select("tree", "pos", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    steps = steps.withColumn("beside", F.expr("shiftright(pos, level) ^ 1"))
    beside = nodes.select("tree", "level", F.col("pos").alias("beside"), F.col("digest").alias("sibling"))
    step = F.struct("level", (F.col("beside") % 2 == 0).alias("left"), "sibling")
    found = steps.join(beside, ["tree", "level", "beside"]).groupBy("tree", "pos").agg(F.sort_array(F.collect_list(step)).alias("proof"))
    none = F.array().cast("array<struct<level:int,left:boolean,sibling:string>>")
    return leaves.select("tree", "pos", "digest").join(found, ["tree", "pos"], "left").withColumn("proof", F.coalesce("proof", none))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(now: Column, s: Column) -> Column:
        return F.when(s["left"], node_hash(s["sibling"], now)).otherwise(node_hash(now, s["sibling"]))

    return F.aggregate(proof, leaf, step)
