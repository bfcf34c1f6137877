"""Damage-aware field confidence, document confidence and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions import similarity
from landq.functions.text import round_to, to_number
from landq.operators.ordered import hot_keys
from landq.sources import rulebook as rb

# fixed values: weights, penalty ceiling and thresholds
W_OCR, W_AGREEMENT, W_FORMAT, W_CONSISTENCY = 0.40, 0.20, 0.20, 0.20
MAX_DAMAGE = 0.35
AUTO_ACCEPT = 0.90
FIELD_REVIEW = 0.60
DEFAULT_AGREEMENT = 0.95
LEAST_AGREEMENT = 0.4
#: Distinct values of a page that are looked for together, and parts of those of a page with more.
PAGE_VALUES, HOT_PARTS = 1000, 64

# rule -> (field-name keywords, consistency score)
CONSISTENCY = {
    rb.SHARES: (("share",), 0.4),
    rb.HOLDING: (("area",), 0.4),
    rb.CHRONOLOGY: (("date",), 0.4),
    rb.CAPACITY: (("owner",), 0.3),
    rb.DUPLICATE: (("survey", "reg"), 0.3),
}


def engine_agreement(fields: DataFrame, texts: DataFrame, page_values: int = PAGE_VALUES) -> DataFrame:
    """Adds agreement: how well each value is found in the other engine's text of the page.

    ``texts``: document_id, page_id, text, one row for a page. A page's distinct values meet its text in one row and are
    looked for in one pass; of a page with very many values, in parts. Rows of fields never carry texts.
    """
    keys = ["document_id", "page_id"]
    value = F.lower(F.col("value").cast("string"))
    asked = fields.withColumn("_value", F.nullif(value, F.lit("")))
    wanted = asked.filter(F.col("_value").isNotNull()).select(*keys, "_value").distinct()
    part = F.lit(0)
    hot = hot_keys(wanted, keys, page_values)
    if hot is not None:
        wanted = wanted.join(hot.withColumn("_hot", F.lit(True)), keys, "left")
        part = F.when(F.col("_hot"), F.pmod(F.xxhash64("_value"), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    lists = wanted.groupBy(*keys, part.alias("_part")).agg(F.collect_list("_value").alias("_values"))
    paged = lists.join(texts.select(*keys, F.lower("text").alias("_text")).filter("_text <> ''"), keys)
    scored = paged.select(*keys, "_values", similarity.partial_ratios(F.col("_values"), F.col("_text")).alias("_ratios"))
    scored = scored.select(*keys, F.explode(F.arrays_zip("_values", "_ratios")).alias("_v"))
    score = round_to(F.greatest(F.lit(LEAST_AGREEMENT), F.col("_v._ratios") / 100.0), 2)
    answers = scored.select(*keys, F.col("_v._values").alias("_value"), score.alias("_score"))
    # rows without a value ask with a key of their own, which nothing answers to
    ask = F.coalesce("_value", F.concat(F.lit("\u0000"), F.xxhash64(*fields.columns).cast("string")))
    joined = asked.withColumn("_value", ask).join(answers, [*keys, "_value"], "left")
    return joined.select(*fields.columns, F.coalesce("_score", F.lit(DEFAULT_AGREEMENT)).alias("agreement"))


def tile_penalty(blur: Column, fade: Column, stain: Column, tear: Column) -> Column:
    """Penalty of one tile, before averaging."""
    zero = F.lit(0.0)
    return (
        F.when(blur < 120.0, 0.15 * (1.0 - F.least(blur / 120.0, F.lit(1.0)))).otherwise(zero)
        + F.when(fade > 0.35, 0.15 * fade).otherwise(zero)
        + F.when(stain > 0.10, 0.12 * stain).otherwise(zero)
        + F.when(tear > 0.05, 0.25 * tear).otherwise(zero)
    )


def page_penalty(blur: Column, fade: Column, stain: Column) -> Column:
    """Fallback for pages without tiles."""
    zero = F.lit(0.0)
    blur, fade, stain = (F.coalesce(c, zero) for c in (blur, fade, stain))
    return (
        F.when(blur < 100.0, 0.12 * (1.0 - F.least(blur / 100.0, F.lit(1.0)))).otherwise(zero)
        + F.when(fade > 0.4, 0.12 * fade).otherwise(zero)
        + F.when(stain > 0.15, 0.10 * stain).otherwise(zero)
    )


def rated_quality(quality: Column) -> Column:
    """struct<tiles, whole>: each tile's box with its penalty, and the fallback for pages without tiles.

    Worked out once per page, before the page meets its fields.
    """
    at = lambda box, i: F.get(box, F.lit(i))
    tiles = F.transform(
        quality["tile_metrics"],
        lambda t: F.struct(
            *[at(t["bbox"], i).alias(n) for i, n in enumerate(("y0", "x0", "y1", "x1"))],
            tile_penalty(
                F.coalesce(t["blur"], F.lit(200.0)),
                F.coalesce(t["fade"], F.lit(0.0)),
                F.coalesce(t["stain"], F.lit(0.0)),
                F.coalesce(t["tear"], F.lit(0.0)),
            ).alias("penalty"),
        ),
    )
    whole = page_penalty(quality["blur_score"], quality["fade_score"], quality["stain_coverage"])
    return F.when(quality.isNotNull(), F.struct(tiles.alias("tiles"), whole.alias("whole")))


def damage_penalty(bbox: Column, rated: Column) -> Column:
    """Penalty under a field's box [ymin, xmin, ymax, xmax]: the mean over the tiles it touches.

    The tiles of a page (a fixed grid) stay nested in its row, so this needs no explode and no second shuffle.
    """
    at = lambda i: F.get(bbox, F.lit(i))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        apart = (at(3) < t["x0"]) | (at(1) > t["x1"]) | (at(2) < t["y0"]) | (at(0) > t["y1"])
        return F.when(apart, acc).otherwise(
            F.struct((acc["total"] + t["penalty"]).alias("total"), (acc["n"] + 1).alias("n"))
        )

    mean = F.aggregate(
        rated["tiles"], start, step, lambda acc: F.coalesce(F.try_divide(acc["total"], acc["n"]), F.lit(0.0))
    )
    raw = F.when(F.coalesce(F.size(rated["tiles"]), F.lit(0)) < 1, rated["whole"]).otherwise(mean)
    usable = rated.isNotNull() & (F.size(bbox) == 4)
    return F.when(F.coalesce(usable, F.lit(False)), F.least(round_to(raw, 4), F.lit(MAX_DAMAGE))).otherwise(0.0)


def format_score(field_name: Column, value: Column) -> Column:
    """How well a value fits the form its field name asks for. Digits of any script count where numbers stand."""
    name, text = F.lower(field_name), F.trim(value.cast("string"))
    number = to_number(text)
    fits = lambda pattern, otherwise: F.when(text.rlike(pattern), 1.0).otherwise(otherwise)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0))
        .when(name.contains("ulpin"), fits("^[A-Z0-9]{14}$", 0.3))
        .when(
            name.contains("date"), fits(r"^(\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}|\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{4})$", 0.4)
        )
        .when(name.rlike("survey|khasra"), fits(r"^\p{Nd}+([/-][\p{Nd}A-Za-z]+)?$", 0.6))
        .when(name.contains("share"), fits(r"^(\p{Nd}+/\p{Nd}+|\p{Nd}+(\.\p{Nd}+)?%?)$", 0.4))
        .when(
            name.contains("area") & ~name.contains("unit"),
            F.when(number > 0, 1.0).when(number.isNotNull(), 0.2).otherwise(0.3),
        )
        .otherwise(1.0)
    )


def failed_rule_flags(results: DataFrame) -> DataFrame:
    """One row per document with a boolean per rule that touches field consistency."""
    failed = results.filter(F.col("status") == "failed")
    return failed.groupBy("document_id").agg(
        *[F.max(F.col("rule_id") == rule).alias(rule) for rule in CONSISTENCY]
    )


def consistency_score(field_name: Column, flags: dict[str, Column]) -> Column:
    name = F.lower(field_name)
    lowered = [F.lit(1.0)]
    for rule, (words, score) in CONSISTENCY.items():
        lowered.append(F.when(flags[rule] & name.rlike("|".join(words)), F.lit(score)).otherwise(1.0))
    return F.least(*lowered)


def breakdown(ocr: Column, agreement: Column, damage: Column, fmt: Column, consistency: Column) -> dict[str, Column]:
    """The six parts of a field's confidence."""
    one, zero = F.lit(1.0), F.lit(0.0)
    ocr = F.greatest(zero, F.least(one, F.when(ocr > 0, ocr).otherwise(0.80)))
    agreement = F.greatest(zero, F.least(one, agreement))
    base = W_OCR * ocr + W_AGREEMENT * agreement + W_FORMAT * fmt + W_CONSISTENCY * consistency
    final = F.greatest(F.lit(0.05), F.least(F.lit(0.99), base - damage))
    parts = {
        "ocr": ocr, "agreement": agreement, "damage_penalty": damage,
        "format": fmt, "consistency": consistency, "final": final,
    }
    return {k: round_to(v, 3) for k, v in parts.items()}


def score_flags(damage: Column, agreement: Column, fmt: Column, consistency: Column) -> Column:
    note = lambda test, label, v: F.when(test, F.concat(F.lit(label), v.cast("string")))
    return F.array_compact(
        F.array(
            note(damage > 0.08, "damage_penalty_applied:-", damage),
            note(agreement < 0.8, "engine_disagreement:", agreement),
            note(fmt < 0.7, "format_anomaly:", fmt),
            note(consistency < 0.7, "consistency_penalty:", consistency),
        )
    )


def score_fields(fields: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Scores every field; replaces confidence by the final score and adds breakdown and flags.

    ``fields``: document_id, page_id, field_name, value, confidence, bbox, agreement, flags.
    ``pages``: page_id, quality. ``results``: validation rows.
    """
    failed = failed_rule_flags(results)
    rated = pages.select("page_id", rated_quality(F.col("quality")).alias("_rated"))
    joined = fields.join(rated, "page_id", "left").join(failed, "document_id", "left")
    flags = {rule: F.coalesce(F.col(rule), F.lit(False)) for rule in CONSISTENCY}
    raw = joined.withColumns(
        {
            "_agree": F.greatest(
                F.lit(0.0), F.least(F.lit(1.0), F.coalesce("agreement", F.lit(DEFAULT_AGREEMENT)))
            ),
            "_damage": damage_penalty(F.col("bbox"), F.col("_rated")),
            "_format": format_score(F.col("field_name"), F.col("value")),
            "_consistent": consistency_score(F.col("field_name"), flags),
        }
    )
    parts = breakdown(F.col("confidence"), F.col("_agree"), F.col("_damage"), F.col("_format"), F.col("_consistent"))
    notes = score_flags(F.col("_damage"), F.col("_agree"), F.col("_format"), F.col("_consistent"))
    kept = [c for c in fields.columns if c not in ("confidence", "flags", "agreement", "confidence_breakdown")]
    return raw.select(
        *kept,
        parts["final"].alias("confidence"),
        F.concat(F.coalesce("flags", F.array().cast("array<string>")), notes).alias("flags"),
        F.struct(*[c.alias(n) for n, c in parts.items()]).alias("confidence_breakdown"),
    )


def overall_confidence(fields: DataFrame) -> DataFrame:
    """Mean field score per document from exact decimal sums."""
    mean = F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("confidence")
    return fields.groupBy("document_id").agg(round_to(mean, 3).alias("overall_confidence"))


def _critical_field() -> Column:
    return F.lower("field_name").rlike("owner|survey|khasra|area|share")


def routing_reasons(fields: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """document_id, field_name, kind, reason: one row per cause of review, never gathered per document."""
    conf = F.col("confidence")
    kind = F.when(_critical_field() & (conf < FIELD_REVIEW), "critical_field").when(conf < AUTO_ACCEPT, "field")
    found = fields.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    reason = F.when(
        F.col("kind") == "critical_field",
        F.format_string("Field '%s' is critical and its confidence is %.2f only", "field_name", "confidence"),
    ).otherwise(F.format_string("Field '%s' should be looked at, its confidence is %.2f", "field_name", "confidence"))
    rows = found.select("document_id", "field_name", "kind", reason.alias("reason"))
    if critical is None:
        return rows
    rule_rows = critical.select(
        "document_id",
        F.lit(None).cast("string").alias("field_name"),
        F.lit("rule").alias("kind"),
        F.lit("A critical rule failed").alias("reason"),
    ).distinct()
    return rows.unionByName(rule_rows)


def critical_documents(results: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Documents with a failed rule or a forensic flag of critical severity."""
    docs = results.filter((F.col("status") == "failed") & (F.col("severity") == "critical")).select("document_id")
    if flags is not None:
        docs = docs.unionByName(flags.filter(F.col("severity") == "critical").select("document_id"))
    return docs.distinct()


def route(fields: DataFrame, overall: DataFrame, critical: DataFrame) -> DataFrame:
    """document_id, overall_confidence, status, priority, flagged_fields."""
    conf = F.col("confidence")
    low = _critical_field() & (conf < FIELD_REVIEW)
    per_doc = fields.groupBy("document_id").agg(
        F.max(low).alias("_critical"),
        F.max(~low & (conf < AUTO_ACCEPT)).alias("_flagged"),
        F.count_if(conf < AUTO_ACCEPT).alias("flagged_fields"),
    )
    joined = (
        overall.join(per_doc, "document_id", "left")
        .join(critical.select("document_id", F.lit(True).alias("_rule")), "document_id", "left")
    )
    no = F.lit(False)
    whole = (
        F.coalesce("_rule", no) | F.coalesce("_critical", no) | (F.col("overall_confidence") < FIELD_REVIEW)
    )
    some = F.coalesce("_flagged", no)
    return joined.select(
        "document_id",
        "overall_confidence",
        F.when(whole, "document_review").when(some, "field_review").otherwise("auto_accepted").alias("status"),
        F.when(whole, "high").when(some, "medium").otherwise("low").alias("priority"),
        F.coalesce("flagged_fields", F.lit(0)).alias("flagged_fields"),
    )


def bare_flagged(fields: DataFrame) -> DataFrame:
    """Fields a reviewer should look at: low confidence or any flag."""
    return fields.filter((F.col("confidence") < AUTO_ACCEPT) | (F.size("flags") > 0))
