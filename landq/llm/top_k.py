"""Exact top-k search by inner product with aggregation of sorted lists and no random access.

Every dimension of a block of vectors is a sorted list. Queries read the lists in turn, from the end where their own
component makes the largest products, and keep for each vector what it has scored so far. Unread entries are worth at
most what the lists have come down to (upper bound) and at least their last entries (lower bound). Reading stops when
few vectors outside could still qualify by their upper bounds; their final scores are then resolved.

The query set meets all vectors in blocks: blocks of vectors times blocks of queries, each pair one task of bounded
memory. Each block's best go on, and the best of these are ranked with a limit before the shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landq.llm.common import stored, table

SCALE = 1024
K = 10
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Queries that read together, share of a list that a step reads, and vectors still in question at which reading stops.
TOGETHER = 64
STEPS = 24
OPEN = 64
EXACT = float(1 << 53)


def search_block(ids, vectors, query_ids, queries, k: int):
    """(query number, vector number, score) of the k best vectors of a block for each query, itself left out."""
    import numpy as np

    n, dims = vectors.shape
    exact = vectors.astype(np.int64)
    vectors, queries_f = vectors.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    step = -(-n // STEPS)
    row_of = {int(v): i for i, v in enumerate(ids)}
    for at in range(0, len(queries), TOGETHER):
        some = queries_f[at : at + TOGETHER]
        up, down = np.maximum(some, 0.0), np.minimum(some, 0.0)
        worth = float((np.abs(some) @ np.abs(vectors).max(axis=0, initial=0.0)).max(initial=0.0)) if dims else 0.0
        slack = 0.0 if worth < EXACT else worth * 1e-12
        score = np.zeros((n, len(some)))
        own = [row_of.get(int(q)) for q in query_ids[at : at + TOGETHER]]
        mine = [(r, j) for j, r in enumerate(own) if r is not None]
        read = 0
        while True:
            if dims == 0:
                read = n
            until = min(n, read + step)
            for d in range(dims if until > read else 0):
                high, low = slice(n - until, n - read), slice(read, until)
                if up[:, d].any():
                    score[order[high, d]] += lists[high, d][:, None] * up[None, :, d]
                if down[:, d].any():
                    score[order[low, d]] += lists[low, d][:, None] * down[None, :, d]
            read = until
            upper = score
            if read < n:
                if 4 * read < n:
                    continue
                from_top, from_bottom = (rank < n - read).astype(np.float64), (rank >= read).astype(np.float64)
                upper = score + from_top @ (up * lists[n - read]).T + from_bottom @ (down * lists[read - 1]).T
                lower = score + from_top @ (up * lists[0]).T + from_bottom @ (down * lists[-1]).T
            else:
                lower = score.copy() if mine else score
                upper = lower
            for r, j in mine:
                lower[r, j] = upper[r, j] = -np.inf
            least = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(some), -np.inf)
            open_ = upper + slack >= least - slack
            if read == n or n > k and open_.sum(axis=0).max() <= max(OPEN, 2 * k):
                break
        for j in range(len(some)):
            rows = np.flatnonzero(open_[:, j])
            rows = rows[rows != own[j]] if own[j] is not None else rows
            final = exact[rows] @ queries[at + j].astype(np.int64)
            best = np.lexsort((ids[rows], -final))[:k]
            for b in best.tolist():
                yield at + j, int(rows[b]), int(final[b])


def _matrix(column, width: int):
    """Lists of one column as rows of a matrix; shorter ones end in zeros."""
    import numpy as np

    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    import numpy as np
    import pyarrow.compute as pc

    names, kinds = ["query_id", "vec_id", "score"], pa.int64()
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], kinds)] * 3, names=names)
    width = max(pc.max(pc.list_value_length(t.column("values"))).as_py() for t in (left, right))
    ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
    found = list(search_block(ids, _matrix(left.column("values"), width), query_ids, _matrix(right.column("values"), width), k))
    q, v, s = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pa.table([pa.array(query_ids[q]), pa.array(ids[v]), pa.array(s)], names=names)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, values: floor(scale * component). Vectors null or with null or non-finite components, or without an id, are left out.

    A vec_id stands for one vector: of repeated rows the smallest vector counts. Extra columns don't pass.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter("vec_id is not null and embedding is not null").filter(usable)
    values = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return rows.select("vec_id", values.alias("values")).groupBy("vec_id").agg(F.min("values").alias("values"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each query by integer inner product, ties to smaller vec_id.

    Both sides: vec_id, values (unique ids). A query's own id is left out. Vectors of unlike length count as ended by
    zeros; empty vectors score 0. With fewer than k others all are returned; no queries or no vectors give no rows.
    """
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    left = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "vec_id", "values"
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("q"), "vec_id", "values"
    )
    left, right = (x.select(F.col("v").cast("long"), F.col("q").cast("long"), "vec_id", "values") for x in (left, right))
    found = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(
        lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP1_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank" from scored
)
select query_id, "rank", vec_id, score from ranked where "rank" <= 10
"""
