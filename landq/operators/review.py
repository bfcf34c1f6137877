"""Review queue, overrides, correction memory and maker-checker state from an append-only event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.sources.dictionaries import role_aliases, role_permissions

OPEN_STATES = ["needs_review", "maker_reviewed", "pending"]
CHECKER_ROLES = ["supervisor", "admin"]
REVIEW_ROUTES = ["field_review", "document_review"]


def create_tasks(routed: DataFrame, reasons: DataFrame, created_at: Column, double_review: Column | None = None) -> DataFrame:
    """One open task per document that routing sends to people; uncertainty = 1 - confidence.

    The reasons stay rows of their own; the task carries the first and their number.
    """
    first = reasons.groupBy("document_id").agg(F.min("reason").alias("reason"), F.count(F.lit(1)).alias("reasons"))
    sent = routed.filter(F.col("status").isin(REVIEW_ROUTES)).join(first, "document_id", "left")
    return sent.select(
        F.sha2(F.concat(F.lit("task:"), F.col("document_id").cast("string")), 256).alias("task_id"),
        "document_id",
        F.lit("needs_review").alias("status"),
        "priority",
        "reason",
        F.coalesce("reasons", F.lit(0)).alias("reasons"),
        (1.0 - F.col("overall_confidence")).alias("uncertainty"),
        (F.lit(False) if double_review is None else double_review).alias("double_review_required"),
        created_at.alias("created_at"),
    )


def queue(
    tasks: DataFrame, limit: int = 50, status: str | None = None, priority: str | None = None, id_column: str = "task_id"
) -> DataFrame:
    """Most uncertain first, newest first among equals, then by id: a top-k, not a sort of the table."""
    if status is None and priority is None:
        picked = tasks.filter(F.col("status").isin(OPEN_STATES))
    else:
        picked = tasks
        if status is not None:
            picked = picked.filter(F.col("status") == status)
        if priority is not None:
            picked = picked.filter(F.col("priority") == priority)
    return picked.orderBy(F.desc("uncertainty"), F.desc("created_at"), F.asc(id_column)).limit(limit)


def queue_with_documents(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    named = documents.select("document_id", "filename", "doc_type")
    return tasks.join(named, "document_id", "left").withColumns(
        {
            "filename": F.coalesce("filename", F.lit("Unknown")),
            "doc_type": F.coalesce("doc_type", F.lit("unknown")),
        }
    )


# ---------------------------------------------------------------- events


def with_stage(events: DataFrame) -> DataFrame:
    """Adds is_checker_stage and allowed, from the acting role's permissions.

    ``events``: role, is_checker (true, false or null = decide by role). Role tables are constants.
    """
    spark = events.sparkSession
    rights = (
        role_permissions(spark)
        .groupBy("role")
        .agg(
            F.max(F.col("permission") == "REVIEW_TASK_MAKER").alias("_maker"),
            F.max(F.col("permission") == "REVIEW_TASK_CHECKER").alias("_checker"),
        )
    )
    known = role_aliases(spark).join(F.broadcast(rights), "role", "left").withColumnRenamed("role", "_role")
    no = F.lit(False)
    joined = events.join(F.broadcast(known), F.lower(events["role"]) == known["alias"], "left").drop("alias")
    maker, checker = F.coalesce("_maker", no), F.coalesce("_checker", no)
    stage = F.coalesce(F.col("is_checker"), F.coalesce(F.col("_role").isin(CHECKER_ROLES), no))
    allowed = (maker | checker) & ~(F.coalesce(F.col("is_checker"), no) & ~checker)
    return joined.withColumns({"is_checker_stage": stage, "allowed": allowed}).drop("_maker", "_checker", "_role")


def split_allowed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted events, quarantined events)."""
    staged = with_stage(events)
    return staged.filter("allowed").drop("allowed"), staged.filter(~F.col("allowed")).drop("allowed")


def apply_overrides(fields: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest override per (document, field): reviewed value, reviewer, time, confidence 1, flag.

    ``overrides``: document_id, field_name, new_value, reviewer_id, ts, event_id.
    """
    latest = overrides.groupBy("document_id", "field_name").agg(
        F.max_by(F.struct("new_value", "reviewer_id", "ts"), F.struct("ts", "event_id")).alias("o")
    )
    joined = fields.join(latest, ["document_id", "field_name"], "left")
    hit = F.col("o").isNotNull()
    flag = F.array(F.concat(F.lit("human_certified_by:"), F.col("o.reviewer_id").cast("string")))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    kept = [c for c in fields.columns if c not in ("confidence", "flags")]
    return joined.select(
        *kept,
        F.when(hit, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.concat(flags, flag)).otherwise(flags).alias("flags"),
        F.coalesce(hit, F.lit(False)).alias("is_reviewed"),
        F.col("o.new_value").alias("reviewed_value"),
        F.col("o.reviewer_id").alias("reviewed_by"),
        F.col("o.ts").alias("reviewed_at"),
    )


def correction_log(overrides: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per override of a known field, with what the model had read."""
    read = fields.select("document_id", "field_name", "raw_text", F.col("value").alias("model_value"))
    return overrides.join(read, ["document_id", "field_name"]).select(
        "event_id",
        "document_id",
        "field_name",
        "raw_text",
        "model_value",
        F.col("new_value").alias("corrected_value"),
        "reviewer_id",
        F.col("ts").alias("created_at"),
    )


def alias_memory(corrections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per raw text (and field): latest correction, number of corrections, last time."""
    keys = keys or ["field_name", "raw_text"]
    return (
        corrections.filter(F.coalesce(F.col("raw_text"), F.lit("")) != "")
        .groupBy(*keys)
        .agg(
            F.max_by("corrected_value", F.struct("created_at", "event_id")).alias("preferred_value"),
            F.count(F.lit(1)).alias("usage_count"),
            F.max("created_at").alias("updated_at"),
        )
    )


def apply_aliases(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds suggested_value: what reviewers made of the same raw text in the same field, else the value."""
    known = aliases.select("field_name", "raw_text", "preferred_value")
    return fields.join(known, ["field_name", "raw_text"], "left").select(
        *fields.columns, F.coalesce("preferred_value", "value").alias("suggested_value")
    )


def review_state(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Current state per task from its events; a fold is not needed, the last event of each kind decides.

    ``tasks``: task_id, document_id, double_review_required, uncertainty.
    ``events``: task_id, reviewer_id, action, is_checker_stage, ts, event_id.
    A checker's rejection is honoured, and one person in both roles is flagged.
    """
    at = F.struct("ts", "event_id")
    checker = F.col("is_checker_stage")
    act = F.struct("action", "reviewer_id", "is_checker_stage")
    last = events.groupBy("task_id").agg(
        F.max_by(act, at).alias("last"),
        F.max_by("reviewer_id", F.when(~checker, at)).alias("maker_id"),
        F.max_by("reviewer_id", F.when(checker, at)).alias("checker_id"),
        F.max(F.when(~checker, F.col("ts"))).alias("maker_completed_at"),
        F.max(F.when(checker, F.col("ts"))).alias("checker_completed_at"),
        F.max("ts").alias("completed_at"),
        F.count(F.lit(1)).alias("events"),
    )
    joined = tasks.join(last, "task_id", "left")
    approved = F.col("last.action") == "approved"
    made = F.col("double_review_required") & ~F.col("last.is_checker_stage")
    none = F.col("last").isNull()
    status = (
        F.when(none, "needs_review")
        .when(made, "maker_reviewed")
        .when(F.col("last.is_checker_stage") & approved, "verified")
        .otherwise(F.col("last.action"))
    )
    document_status = (
        F.when(none, "needs_review")
        .when(made, "maker_reviewed")
        .when(approved, "published")
        .otherwise("rejected")
    )
    final = ~none & ~made
    return joined.select(
        "task_id",
        "document_id",
        status.alias("status"),
        document_status.alias("document_status"),
        "maker_id",
        "checker_id",
        F.when(final, F.col("completed_at")).alias("completed_at"),
        F.when(final, F.greatest(F.lit(0.99), 1.0 - F.col("uncertainty")))
        .otherwise(1.0 - F.col("uncertainty"))
        .alias("overall_confidence"),
        F.coalesce(F.col("maker_id") == F.col("checker_id"), F.lit(False)).alias("same_person"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def correction_messages(corrections: DataFrame) -> DataFrame:
    """created_at, event_id, line: each correction as one chat-format JSON line."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ask = F.concat(
        F.lit("Extract field '"), "field_name", F.lit("' from raw text: '"), F.coalesce("raw_text", F.lit("")), F.lit("'")
    )
    # fixed values: the wording that stored training lines have
    messages = F.array(
        message("system", F.lit("Extract standardized land record field.")),
        message("user", ask),
        message("assistant", F.coalesce(F.col("corrected_value").cast("string"), F.lit("None"))),
    )
    return corrections.select("created_at", "event_id", F.to_json(F.struct(messages.alias("messages"))).alias("line"))
