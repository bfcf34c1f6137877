"""The whole archive as one job: records in, validated, scored, cross-checked and routed tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.functions.text import indic_to_ascii, to_number, transliterate
from landq.operators import confidence, forensics, geo, review, rules
from landq.operators import normalize as norm
from landq.operators import records as rec
from landq.session import cut_lineage
from landq.sources.rulebook import RuleBook


@dataclass
class Archive:
    """Result tables of one run, keyed by document_id."""

    documents: DataFrame
    fields: DataFrame
    results: DataFrame
    summary: DataFrame
    geo: DataFrame
    flags: DataFrame
    risk: DataFrame
    reasons: DataFrame
    tasks: DataFrame


def normalized_records(records: DataFrame) -> DataFrame:
    """Single-valued fields with ASCII digits, canonical land class and converted area."""
    scalars = rec.scalar_records(records)
    digits = scalars.withColumns(
        {
            "survey_no": indic_to_ascii(F.col("survey_no")),
            "raw_class": F.col("land_class"),
            "area_number": to_number(F.col("area_value")),
            "area_unit": F.coalesce(F.nullif(F.col("area_unit"), F.lit("")), F.lit("guntha")),
        }
    ).drop("land_class", "area_value")
    classed = norm.normalize_land_class(digits, "raw_class", "document_id")
    converted = norm.convert_area(classed, "area_number", "area_unit", "state")
    return converted.withColumns(
        {
            "holding_sqm": F.coalesce("area_sqm", "holding_sqm"),
            "holding_ha": F.coalesce("area_hectares", "holding_ha"),
        }
    )


def normalized_fields(records: DataFrame, scalars: DataFrame) -> DataFrame:
    """Extracted fields with the values that later steps judge: ASCII digits in survey and khata numbers, the canonical
    land class; owner names carry their Latin form as a flag."""
    fields = rec.flatten_fields(records)
    classes = scalars.select("document_id", F.col("land_class").alias("_class"))
    name = F.col("field_name")
    value = (
        F.when(name.isin("survey_no", "khata_no") & F.col("value").isNotNull(), indic_to_ascii(F.col("value")))
        .when((name == "land_classification") & F.col("_class").isNotNull(), F.col("_class"))
        .otherwise(F.col("value"))
    )
    changed = {"value": value}
    if "flags" in fields.columns:
        latin = F.concat(F.lit("canonical_latin_name:"), transliterate(F.col("value")))
        named = name.rlike("^owner_[0-9]+_name$") & (F.col("value") != "")
        known = F.coalesce("flags", F.array().cast("array<string>"))
        changed["flags"] = F.when(named, F.array_append(known, latin)).otherwise(F.col("flags"))
    return fields.join(classes, "document_id", "left").withColumns(changed).drop("_class")


def process(
    records: DataFrame,
    pages: DataFrame,
    parcels: DataFrame,
    scan_flags: list[DataFrame],
    book: RuleBook,
    as_of: str,
) -> Archive:
    """``records``: document_id, extraction, agreements. ``pages``: document_id, page_id, quality.
    ``scan_flags``: indicator rows measured from the images (see forensics)."""
    # three stages read these; the checkpoint keeps them from being computed over again
    scalars = cut_lineage(normalized_records(records))
    owners, mutations = rec.owner_rows(records), rec.mutation_rows(records)
    results = cut_lineage(rules.validate(scalars, owners, mutations, book, as_of))

    # one page per document is scored: its first
    first_page = pages.groupBy("document_id").agg(F.min("page_id").alias("page_id"))
    agreed = rec.agreement_rows(records)
    fields = (
        normalized_fields(records, scalars)
        .join(first_page, "document_id", "left")
        .join(agreed, ["document_id", "field_name"], "left")
    )
    scored = cut_lineage(confidence.score_fields(fields, pages, results))
    overall = confidence.overall_confidence(scored)

    lookups = scalars.withColumns(
        {
            "text_sqm": F.col("holding_sqm"),
            "boundaries": F.create_map().cast("map<string,string>"),
        }
    )
    checked = geo.cross_check(lookups, parcels)

    documents = records.select("document_id")
    flags = forensics.assemble_flags(documents, [*scan_flags, forensics.text_logic_flags(results)])
    critical = confidence.critical_documents(results, flags)
    routed = confidence.route(scored, overall, critical)
    reasons = confidence.routing_reasons(scored, critical)
    return Archive(
        documents=routed,
        fields=scored,
        results=results,
        summary=rules.summarize(documents, results),
        geo=checked,
        flags=flags,
        risk=forensics.tamper_risk(flags),
        reasons=reasons,
        tasks=review.create_tasks(routed, reasons, F.lit(as_of).cast("timestamp")),
    )
