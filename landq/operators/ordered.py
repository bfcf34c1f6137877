"""Ordered analysis per key that stays parallel when one key holds a large part of the rows.

A window over ``partition by key`` puts a key into one task. Keys above ``hot_rows`` rows are therefore
split along the order itself (by the given ``splits``, coarse columns that sort like the order does), the
window runs per split, and small per-split summaries carry the state from one split to the next.
The result is the same as that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
LISTED_KEYS = 10_000


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows as a table, or None when there are none.

    Counts combine before the shuffle. Up to LISTED_KEYS keys come back as a broadcast constant table;
    beyond that the table stays distributed and the join on it is an ordinary one.
    """
    hot = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    listed = hot.limit(LISTED_KEYS + 1).collect()
    if not listed:
        return None
    if len(listed) > LISTED_KEYS:
        return hot
    return F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))


def _same(keys: list[str], left: str, right: str) -> Column:
    """Equal keys; rows without a key are a group like any other."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _split(df: DataFrame, hot: DataFrame, keys: list[str], splits: list[Column]) -> DataFrame:
    parted = df.withColumn("_part", F.struct(*splits))
    joined = parted.alias("d").join(hot.withColumn("_hot", F.lit(True)).alias("h"), _same(keys, "d", "h"), "left")
    return joined.select(
        *[F.col(f"d.{c}") for c in df.columns], F.when(F.col("h._hot"), F.col("d._part")).alias("_part")
    )


def _same_part(keys: list[str], left: str, right: str) -> Column:
    return (F.col(f"{left}._part") == F.col(f"{right}._part")) & _same(keys, left, right)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    splits: list[Column],
    out: str = "rn",
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """row_number() over (partition by keys order by order), ascending.

    ``counted`` may give the rows to count per key when that is cheaper than counting ``df`` itself.
    """
    hot = hot_keys(df if counted is None else counted, keys, hot_rows)
    if hot is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    marked = _split(df, hot, keys, splits)
    local = marked.withColumn(
        out, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("long")
    )
    sizes = marked.filter(F.col("_part").isNotNull()).groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.sum("_n").over(before)).drop("_n")
    joined = local.alias("l").join(offsets.alias("o"), _same_part(keys, "l", "o"), "left")
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, (F.col(f"l.{out}") + F.coalesce(F.col("o._offset"), F.lit(0))).alias(out))


def lagged(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    splits: list[Column],
    columns: dict[str, str],
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """lag(column, 1) over (partition by keys order by order) for each ``out: column``."""
    hot = hot_keys(df if counted is None else counted, keys, hot_rows)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({out: F.lag(c).over(w) for out, c in columns.items()})
    marked = _split(df, hot, keys, splits)
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    local = marked.withColumns({out: F.lag(c).over(w) for out, c in columns.items()})
    local = local.withColumn("_first", F.row_number().over(w) == 1)
    tail = F.max_by(F.struct(*[F.col(c).alias(out) for out, c in columns.items()]), F.struct(*order))
    tails = marked.filter(F.col("_part").isNotNull()).groupBy(*keys, "_part").agg(tail.alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_part")))
    joined = local.alias("l").join(tails.alias("t"), _same_part(keys, "l", "t"), "left")
    kept = [F.col(f"l.{c}") for c in df.columns]
    filled = [
        F.when(F.col("l._first"), F.col(f"t._tail.{out}")).otherwise(F.col(f"l.{out}")).alias(out)
        for out in columns
    ]
    return joined.select(*kept, *filled)


def trailing_count(
    df: DataFrame, key: str, ts: str, seconds: int, out: str = "n", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including this row's time."""
    hot = hot_keys(df, [key], hot_rows)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    if hot is None:
        w = Window.partitionBy(key).orderBy("_us").rangeBetween(-span, 0)
        return df.withColumn("_us", micros).withColumn(out, F.count(F.lit(1)).over(w)).drop("_us")
    # equal times share one answer; each time also visits the next slot as history for it
    times = df.groupBy(F.col(key), micros.alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    slot = F.floor(F.col("_us") / span)
    visits = times.withColumn("_own", slot).withColumn(
        "_slot", F.explode(F.array(F.col("_own"), F.col("_own") + 1))
    )
    w = Window.partitionBy(key, "_slot").orderBy("_us").rangeBetween(-span, 0)
    counted = visits.withColumn(out, F.sum("_n").over(w)).filter(F.col("_own") == F.col("_slot"))
    timed = df.withColumn("_us", micros).alias("d")
    same = (F.col("d._us") == F.col("c._us")) & _same([key], "d", "c")
    return timed.join(counted.alias("c"), same).select(*[F.col(f"d.{c}") for c in df.columns], F.col(f"c.{out}"))
