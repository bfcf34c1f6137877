"""Index lookups against scans, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from landq.operators import listing, lookup_index


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    make = lambda: "".join(rng.choice("abCd_é1") for _ in range(rng.randint(0, 9)))
    rows = [(i, make(), make() if i % 3 else None, ["x", "y", None][i % 3], i % 17) for i in range(600)]
    return spark.createDataFrame(rows, "id long, name string, texts string, kind string, t int").repartition(6).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search"))
    lookup_index.build_search_index(table, "id", ["name", "texts", "id"], path)
    return path


@pytest.mark.parametrize("listed", [10_000, 0])
def test_search_equals_the_scan(spark, table, index, monkeypatch, listed):
    monkeypatch.setattr(lookup_index, "LISTED", listed)
    names = [r.name for r in table.limit(40).collect()]
    terms = ["", "a", "É", "1a", "zzz", "abcda", "12", "123", "599", *[n[1:5] for n in names if len(n) > 6][:4]]
    for term in terms:
        want = {r.id for r in listing.search(table, term, ["name", "texts", "id"]).collect()}
        got = [r.id for r in lookup_index.search(spark, index, term).collect()]
        assert sorted(got) == sorted(want), term


def test_search_skips(spark, index):
    plan = lookup_index.search(spark, index, "abc")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [IsNotNull" in plan or "EqualTo(id" in plan


def test_pages(spark, table, tmp_path):
    lookup_index.build_page_index(table, "t", "id", str(tmp_path / "all"), parts=7)
    lookup_index.build_page_index(table, "t", "id", str(tmp_path / "kinds"), ["kind"], 5)
    ids = lambda df: [r.id for r in df.collect()]
    for offset, limit in ((0, 5), (3, 200), (590, 20), (599, 1), (600, 5), (10**6, 5), (100, 1)):
        assert ids(lookup_index.page(spark, str(tmp_path / "all"), "t", "id", offset, limit)) == ids(listing.page(table, "t", "id", offset, limit))
        got = ids(lookup_index.page(spark, str(tmp_path / "kinds"), "t", "id", offset, limit, kind="y"))
        assert got == ids(listing.page(table, "t", "id", offset, limit, kind="y"))
    assert spark.read.parquet(str(tmp_path / "all" / "rows")).select("part").distinct().count() > 3
    deep = lookup_index.page(spark, str(tmp_path / "all"), "t", "id", 300, 10)._jdf.queryExecution().executedPlan().toString()
    assert "part" in deep.split("PartitionFilters: [")[1].split("]")[0] and deep.count("Exchange") <= 1


def test_nothing(spark, table, tmp_path):
    none = table.filter(F.lit(False))
    lookup_index.build_page_index(none, "t", "id", str(tmp_path / "pages"))
    lookup_index.build_search_index(none, "id", ["name"], str(tmp_path / "search"))
    assert lookup_index.page(spark, str(tmp_path / "pages"), "t", "id", 0, 5).columns == table.columns
    assert lookup_index.search(spark, str(tmp_path / "search"), "abc").count() == 0


def test_lists_are_dealt_by_their_entries(spark, tmp_path, monkeypatch):
    """Small files of a common piece hold many entries; a task sorts a bounded number of them."""
    monkeypatch.setattr(lookup_index, "DEALT", 500, raising=False)
    df = spark.range(2000).selectExpr("id", "concat('abc', id) t")
    lookup_index.build_search_index(df, "id", ["t"], str(tmp_path / "x"))
    lists = spark.read.parquet(str(tmp_path / "x" / "lists"))
    files = lists.groupBy("_metadata.file_path").count().collect()
    assert max(r["count"] for r in files) < 2000
    assert {r.id for r in lookup_index.search(spark, str(tmp_path / "x"), "BC1").collect()} == {i for i in range(2000) if str(i)[0] == "1"}
