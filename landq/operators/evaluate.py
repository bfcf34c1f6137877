"""Extraction quality against known values, from real comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.functions import similarity

PASSING_SHARE = 0.85


def compare(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """document_id, field_name, is_exact, similarity for every non-empty true field.

    Equal values score 100 without leaving the JVM; of the others each distinct pair is scored once.
    """
    keys = ["document_id", "field_name"]
    known = truth.filter(F.coalesce(F.col("value"), F.lit("")) != "").withColumnRenamed("value", "true_value")
    read = extracted.select(*keys, F.coalesce("value", F.lit("")).alias("read_value"), "confidence")
    pairs = known.join(read, keys, "left").withColumn("read_value", F.coalesce("read_value", F.lit("")))
    same = F.trim("true_value") == F.trim("read_value")
    scored = (
        pairs.filter(~same)
        .select("true_value", "read_value")
        .distinct()
        .withColumn("_ratio", similarity.indel_ratio(F.lower("true_value"), F.lower("read_value")))
    )
    # rows that agree ask with a key of their own, so that no common value gathers in one task
    asks = F.when(same, F.concat(F.lit("\u0000"), F.xxhash64(*keys).cast("string"))).otherwise(F.col("true_value"))
    asking = pairs.withColumns({"_same": same, "_ask": asks})
    answers = scored.toDF("_true", "_read", "_ratio")
    found = asking.join(answers, (F.col("_ask") == F.col("_true")) & (F.col("read_value") == F.col("_read")), "left")
    return found.select(
        *[c for c in known.columns],
        "read_value",
        "confidence",
        F.col("_same").alias("is_exact"),
        F.when(F.col("_same"), F.lit(100.0)).otherwise(F.col("_ratio")).alias("similarity"),
    )


def field_accuracy(compared: DataFrame) -> DataFrame:
    """Per field: rows, exact share and mean similarity in percent."""
    total = F.count(F.lit(1))
    return compared.groupBy("field_name").agg(
        total.alias("n"),
        F.count_if("is_exact").alias("exact"),
        (F.count_if("is_exact") * 100.0 / total).alias("exact_pct"),
        (F.sum(F.col("similarity").cast("decimal(28,8)")).cast("double") / total).alias("similarity_pct"),
    )


def language_performance(compared: DataFrame, documents: DataFrame) -> DataFrame:
    """Per language: share of documents with at least 85 % exact fields. ``documents``: document_id, language."""
    per_doc = compared.groupBy("document_id").agg(
        (F.count_if("is_exact") / F.count(F.lit(1)) >= PASSING_SHARE).alias("passed")
    )
    joined = documents.select("document_id", "language").join(per_doc, "document_id", "left")
    passed = F.count_if(F.coalesce(F.col("passed"), F.lit(False)))
    return joined.groupBy("language").agg(
        F.count(F.lit(1)).alias("documents"), (passed * 100.0 / F.count(F.lit(1))).alias("passed_pct")
    )


def fault_recall(faults: DataFrame, results: DataFrame, detects: DataFrame) -> DataFrame:
    """Per injected fault: share of documents whose expected rule failed.

    ``faults``: document_id, fault. ``detects``: fault, rule_id (one row per known fault type).
    """
    failed = results.filter(F.col("status") == "failed").select("document_id", "rule_id").distinct()
    expected = faults.join(detects, "fault")
    found = expected.join(failed.withColumn("_hit", F.lit(True)), ["document_id", "rule_id"], "left")
    return found.groupBy("fault").agg(
        F.count(F.lit(1)).alias("n"), (F.count("_hit") * 100.0 / F.count(F.lit(1))).alias("recall_pct")
    )


def overall_accuracy(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if("is_exact") * 100.0 / F.count(F.lit(1))).alias("accuracy_pct"),
    )
