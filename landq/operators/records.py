"""From nested record documents to the tables the other operators work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# field name -> path inside the record; mandatory fields first, optional ones only when present
FIELD_PATHS = {
    "document_type": "document_type",
    "state": "state",
    "district": "district",
    "tehsil": "tehsil",
    "village": "village",
    "survey_no": "survey_no",
    "khasra_no": "khasra_no",
    "khata_no": "khata_no",
    "sub_division": "sub_division",
    "ulpin": "ulpin",
    "plot_area_value": "plot_area.value",
    "plot_area_unit": "plot_area.unit",
    "land_classification": "land_classification",
    "ownership_type": "ownership_type",
    "encumbrances": "encumbrances_or_loans",
    "remarks": "remarks_or_annotations",
    "na_order_ref": "na_conversion_order_ref",
    "tenure_perm_ref": "restricted_tenure_permission_ref",
    "reg_no": "registration.reg_no",
    "reg_date": "registration.reg_date",
    "sub_registrar_office": "registration.sub_registrar_office",
}
OWNER_FIELDS = {
    "name": "name",
    "share": "share",
    "father_husband": "father_or_husband_name",
    "is_minor": "is_minor",
    "is_deceased": "is_deceased",
}
MUTATION_FIELDS = {
    "no": "mutation_no",
    "date": "mutation_date",
    "reg_date": "registration_date",
    "from": "from_party",
    "to": "to_party",
    "area": "transferred_area",
    "order_ref": "order_ref",
}

#: Rows that a task sorts, on average; compressed sizes, by which Spark would deal them, tell little about memory.
DEALT = 250_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // DEALT))


def _entries(pairs: list[tuple[Column, Column]]) -> Column:
    """Rows of (field_name, item) for the items that are there."""
    structs = [F.struct(name.alias("field_name"), item.alias("item")) for name, item in pairs]
    return F.filter(F.array(*structs), lambda e: e["item"].isNotNull())


def flatten_fields(records: DataFrame) -> DataFrame:
    """One row per extracted field: document_id, field_name and the item's columns. One pass, no shuffle.

    ``records``: document_id, extraction.
    """
    fixed = _entries([(F.lit(n), F.col(f"extraction.{p}")) for n, p in FIELD_PATHS.items()])

    def numbered(items: Column, prefix: str, fields: dict[str, str]) -> Column:
        return F.flatten(
            F.transform(
                F.coalesce(items, F.array()),
                lambda item, i: _entries(
                    [(F.concat(F.lit(prefix), i.cast("string"), F.lit(f"_{n}")), item[p]) for n, p in fields.items()]
                ),
            )
        )

    owners = numbered(F.col("extraction.landowners"), "owner_", OWNER_FIELDS)
    mutations = numbered(F.col("extraction.mutation_entries"), "mutation_", MUTATION_FIELDS)
    exploded = records.select("document_id", F.explode(F.concat(fixed, owners, mutations)).alias("e"))
    return exploded.select("document_id", F.col("e.field_name").alias("field_name"), "e.item.*")


def scalar_records(records: DataFrame) -> DataFrame:
    """One row per document with the single-valued fields as columns."""
    value = lambda path: F.col(f"extraction.{path}.value")
    return records.select(
        "document_id",
        value("document_type").alias("document_type"),
        value("state").alias("state"),
        value("district").alias("district"),
        value("tehsil").alias("tehsil"),
        value("village").alias("village"),
        value("survey_no").alias("survey_no"),
        value("sub_division").alias("sub_division"),
        value("ulpin").alias("ulpin"),
        value("plot_area.value").alias("area_value"),
        value("plot_area.unit").alias("area_unit"),
        value("plot_area.area_sqm").try_cast("double").alias("holding_sqm"),
        value("plot_area.area_hectares").try_cast("double").alias("holding_ha"),
        value("land_classification").alias("land_class"),
        value("ownership_type").alias("ownership_type"),
        value("na_conversion_order_ref").alias("na_order_ref"),
        value("restricted_tenure_permission_ref").alias("tenure_perm_ref"),
        value("registration.reg_no").alias("reg_no"),
        value("registration.reg_date").alias("reg_date"),
    )


def owner_rows(records: DataFrame) -> DataFrame:
    exploded = records.select("document_id", F.posexplode("extraction.landowners").alias("pos", "o"))
    return exploded.select(
        "document_id",
        "pos",
        F.col("o.name.value").alias("name"),
        F.col("o.father_or_husband_name.value").alias("father_husband"),
        F.col("o.share.value").alias("share"),
        F.col("o.share.raw_text").alias("share_raw"),
        F.col("o.is_minor.value").alias("is_minor"),
        F.col("o.is_deceased.value").alias("is_deceased"),
    )


def mutation_rows(records: DataFrame) -> DataFrame:
    exploded = records.select("document_id", F.posexplode("extraction.mutation_entries").alias("idx", "m"))
    names = [
        "mutation_no", "mutation_date", "registration_date", "mutation_type",
        "from_party", "to_party", "transferred_area", "order_ref",
    ]
    return exploded.select("document_id", "idx", *[F.col(f"m.{n}.value").alias(n) for n in names])


def agreement_rows(records: DataFrame) -> DataFrame:
    return records.select("document_id", F.explode("agreements").alias("field_name", "agreement"))


def effective_values(fields: DataFrame) -> DataFrame:
    """A reviewed value replaces the model's; missing flags and boxes get their defaults."""
    from landq.functions.text import round_to

    whole_page = F.array(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])
    reviewed = F.col("is_reviewed") & F.col("reviewed_value").isNotNull()
    return fields.withColumns(
        {
            "value": F.when(reviewed, F.col("reviewed_value")).otherwise(F.col("value")),
            "confidence": round_to(F.col("confidence"), 4),
            "flags": F.coalesce("flags", F.array().cast("array<string>")),
            "bbox": F.coalesce("bbox", whole_page),
        }
    )


def named_fields(fields: DataFrame, names: list[str]) -> DataFrame:
    return fields.filter(F.col("field_name").isin(names)).select("document_id", "field_name", "value")


def widen(fields: DataFrame, names: list[str], tasks: int | None = None) -> DataFrame:
    """One wide row per document; the name list is given, so one aggregation does it.

    Fields are dealt by document before they are grouped. Most documents have a name once, so grouping them first would
    only sort all that a task reads and shuffle rows that are wide and nearly empty.
    """
    kept = named_fields(fields, names)
    tasks = tasks or tasks_for(kept.count())
    picks = [F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names]
    return kept.repartition(tasks, "document_id").groupBy("document_id").agg(*picks)


def merge_pages(pages: DataFrame, name: str, page: str = "page_no", pos: str = "pos") -> DataFrame:
    """Rows of a multi-page document: page 1 as it is, later pages only with names unseen so far.

    The earliest later occurrence wins. Page-1 rows never enter an aggregation.
    """
    first, later = pages.filter(F.col(page) == 1), pages.filter((F.col(page) > 1) & (F.col(name) != ""))
    seen = first.select("document_id", name).distinct()
    fresh = later.join(seen, ["document_id", name], "left_anti")
    rest = [c for c in pages.columns if c not in ("document_id", name)]
    kept = fresh.groupBy("document_id", name).agg(
        F.min_by(F.struct(*rest), F.struct(page, pos, *[c for c in rest if c not in (page, pos)])).alias("r")
    )
    return first.unionByName(kept.select("document_id", name, "r.*"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
