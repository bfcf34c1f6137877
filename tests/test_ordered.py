"""Splitting a hot key must not change what the plain window gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from landq.operators import ordered, ownership


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(11)
    rows = [
        (rng.choice(["hot", "hot", None, f"k{rng.randint(0, 40)}", f"k{rng.randint(0, 40)}"]), rng.randint(0, 30), i, rng.randint(0, 9), rng.randint(0, 4000))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "k string, day int, id int, v int, s int")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [100, 10_000])
def test_rank(events, limit):
    got = ordered.ranked(events, ["k"], ["day", "id"], [F.col("day")], "rn", limit).select("k", "id", "rn")
    w = Window.partitionBy("k").orderBy("day", "id")
    assert rows(got) == rows(events.select("k", "id", F.row_number().over(w)))


@pytest.mark.parametrize("limit", [100, 10_000])
def test_lag(events, limit):
    got = ordered.lagged(events, ["k"], ["day", "id"], [F.col("day")], {"before": "v"}, limit)
    w = Window.partitionBy("k").orderBy("day", "id")
    want = events.select("k", "id", F.coalesce(F.lag("v").over(w), F.lit(-1)))
    assert rows(got.select("k", "id", F.coalesce("before", F.lit(-1)))) == rows(want)


@pytest.mark.parametrize("limit", [100, 10_000])
def test_trailing_count(events, limit):
    got = ordered.trailing_count(events, "k", "ts", 60, "n", limit).select("k", "id", "n")
    w = Window.partitionBy("k").orderBy("s").rangeBetween(-60, 0)
    assert rows(got) == rows(events.select("k", "id", F.count(F.lit(1)).over(w)))


def test_hot_keys(events):
    assert ordered.hot_keys(events, ["k"], 1_000_000) is None
    assert {r[0] for r in ordered.hot_keys(events, ["k"], 300).collect()} == {"hot", None}


def test_more_hot_keys_than_can_be_listed(events, monkeypatch):
    monkeypatch.setattr(ordered, "LISTED_KEYS", 2)
    got = ordered.ranked(events, ["k"], ["day", "id"], [F.col("day")], "rn", 10).select("k", "id", "rn")
    w = Window.partitionBy("k").orderBy("day", "id")
    assert rows(got) == rows(events.select("k", "id", F.row_number().over(w)))


def test_partitioning_does_not_change_a_timeline(spark):
    data = [(p, d, i, f"M-{i}", f"20{10 + i % 5}-01-0{1 + i % 9}", "sale", "A", "B", 1.0, None) for p in range(3) for d in range(4) for i in range(5)]
    ddl = "parcel_id int, document_id long, idx int, mutation_no string, mutation_date string, mutation_type string, from_party string, to_party string, transferred_area double, order_ref string"
    df = spark.createDataFrame(data, ddl)
    base = rows(ownership.timeline(df.coalesce(1)).select("parcel_id", "document_id", "idx", "rn"))
    shuffled = df.orderBy(F.desc("mutation_no")).repartition(7)
    assert rows(ownership.timeline(shuffled).select("parcel_id", "document_id", "idx", "rn")) == base
