"""Dashboards: one aggregation per table instead of a query per figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.text import round_to

ACCEPTED = ["auto_accepted", "certified"]
PENDING = ["field_review", "document_review", "uploaded", "preprocessed"]
IN_REVIEW = ["field_review", "document_review", "needs_review", "maker_reviewed"]
SEVERE = ["critical", "error"]
STRAIGHT = 0.90


def _mean(column: str) -> Column:
    return F.try_divide(F.sum(F.col(column).cast("decimal(28,10)")).cast("double"), F.count(column).cast("double"))


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole.cast("double"))


def dashboard(documents: DataFrame, results: DataFrame) -> DataFrame:
    """One row: document counts by state, mean confidence, validation counts, auto-accept rate."""
    is_in = lambda names: F.count_if(F.col("status").isin(names))
    docs = documents.agg(
        F.count(F.lit(1)).alias("total_documents"),
        is_in(ACCEPTED).alias("auto_accepted"),
        is_in(PENDING).alias("pending_review"),
        is_in(["rejected"]).alias("rejected"),
        round_to(F.coalesce(_mean("overall_confidence"), F.lit(0.0)), 3).alias("average_confidence"),
        F.coalesce(round_to(_percent(is_in(ACCEPTED), F.count(F.lit(1))), 1), F.lit(0.0)).alias("auto_accept_rate_pct"),
    )
    failed = F.col("status") == "failed"
    checks = results.agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if(failed).alias("failed_validations"),
        F.count_if(failed & F.col("severity").isin(SEVERE)).alias("critical_flags"),
    )
    one = F.lit(1).alias("_k")
    return docs.select("*", one).join(checks.select("*", one), "_k").drop("_k")


def type_distribution(documents: DataFrame, column: str = "doc_type") -> DataFrame:
    return documents.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def place_rollup(documents: DataFrame) -> DataFrame:
    """Counts per state, district, tehsil with subtotals."""
    return documents.rollup("state", "district", "tehsil").agg(F.count(F.lit(1)).alias("n"))


def recent_activity(log: DataFrame, limit: int = 10, id_column: str = "id") -> DataFrame:
    return log.orderBy(F.desc("ts"), F.asc(id_column)).limit(limit)


def chart_series(distribution: DataFrame, column: str = "doc_type") -> DataFrame:
    """name, value rows for a chart."""
    return distribution.select(F.col(column).alias("name"), F.col("n").alias("value"))


def programme_kpis(documents: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Published, in review, rejected and the two rates, per group when asked; null where nothing counts."""
    published = F.col("status") == "published"
    whole = F.count(F.lit(1))
    straight = F.count_if(published & (F.col("overall_confidence") >= STRAIGHT))
    return documents.groupBy(*(by or [])).agg(
        whole.alias("documents"),
        F.count_if(published).alias("published"),
        F.count_if(F.col("status").isin(IN_REVIEW)).alias("in_review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        round_to(_percent(F.count_if(published), whole), 1).alias("computerization_pct"),
        round_to(_percent(straight, F.count_if(published)), 1).alias("straight_through_pct"),
    )


def review_kpis(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.col("status").isin("approved", "verified")).alias("completed"),
        F.count_if(F.col("status") == "maker_reviewed").alias("maker_reviewed"),
    )


def linkage_kpi(parcels: DataFrame, geometry: str = "ring") -> DataFrame:
    """Share of parcels that have a geometry, in percent; null without parcels."""
    return parcels.agg(
        F.count(F.lit(1)).alias("parcels"),
        F.count(geometry).alias("linked"),
        round_to(_percent(F.count(geometry), F.count(F.lit(1))), 1).alias("linkage_pct"),
    )
