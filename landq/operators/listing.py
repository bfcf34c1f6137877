"""Ingest by content, listings, search, nested views and linkage to the cadastre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.text import first_filled, mask_name, spread, spread_over
from landq.operators.records import named_fields, tasks_for, widen
from landq.operators.rules import HASHED
from landq.sources.dictionaries import has_permission


# fields an export row is made of; of several names for one thing the first filled one counts
EXPORT_FIELDS = [
    "owner_name", "khatadar_name", "owner_0_name", "survey_or_khasra_no", "survey_no", "khasra_no", "ulpin", "village",
    "area_sqm", "plot_area_sqm", "plot_area_value", "land_type", "land_class", "land_classification",
]


def ingest(uploads: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new documents, duplicate uploads). ``uploads``: content, path, ts. ``history``: sha256, document_id.

    The first upload of each content wins; contents already on file are never inserted again. Only hash,
    path and time take part in the shuffles, not the content.
    """
    hashed = uploads.select(
        F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"), "path", "ts"
    )
    first = hashed.groupBy("sha256").agg(F.min(F.struct("ts", "path", "size")).alias("f"))
    fresh = first.select("sha256", F.col("f.path").alias("path"), F.col("f.ts").alias("ts"), F.col("f.size").alias("size"))
    if history is not None:
        fresh = fresh.join(history.select("sha256"), "sha256", "left_anti")
    again = hashed.join(fresh.select("sha256", F.col("path").alias("kept_path")), "sha256", "left")
    duplicates = again.filter(~F.col("path").eqNullSafe(F.col("kept_path"))).select("sha256", "path", "ts", "kept_path")
    return fresh, duplicates


def page(df: DataFrame, newest: str, id_column: str, offset: int, limit: int, **equal: str | None) -> DataFrame:
    """Equality filters (only those given), newest first, then by id; one page. A top-k of offset + limit."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(F.desc(newest), F.asc(id_column)).offset(offset).limit(limit)


def page_after(df: DataFrame, newest: str, id_column: str, last_time: Column, last_id: Column, limit: int) -> DataFrame:
    """Keyset page: rows after the last one seen, whatever their number; the filter reaches the scan."""
    later = (F.col(newest) < last_time) | ((F.col(newest) == last_time) & (F.col(id_column) > last_id))
    return df.filter(later).orderBy(F.desc(newest), F.asc(id_column)).limit(limit)


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return df.filter(hit)


def children_of(table: DataFrame, document_id: object) -> DataFrame:
    """Rows of one document; the equality reaches the scan and its partition or bucket."""
    return table.filter(F.col("document_id") == F.lit(document_id))


def document_view(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Documents with their child rows nested, each child grouped by document before it is joined.

    The nested arrays are the feature; ask for the documents to show, not for an archive.
    """
    view = documents
    for name, child in children.items():
        wanted = child.join(documents.select("document_id"), "document_id", "left_semi")
        body = F.struct(*[c for c in child.columns if c != "document_id"])
        grouped = wanted.groupBy("document_id").agg(F.array_sort(F.collect_list(body)).alias(name))
        view = view.join(grouped, "document_id", "left")
    return view


def export_rows(documents: DataFrame, fields: DataFrame, role: str) -> DataFrame:
    """Twelve columns per document, first filled alternative of each, owner masked unless permitted.

    Documents and fields are dealt to as many tasks as their rows ask for.
    """
    tasks = tasks_for(max(named_fields(fields, EXPORT_FIELDS).count(), documents.count()))
    wide = widen(fields, EXPORT_FIELDS, tasks)
    listed = documents.select(
        "document_id", "filename", "doc_type", "status", "overall_confidence", "created_at"
    )
    joined = listed.repartition(tasks, "document_id").join(wide.hint("merge"), "document_id", "left")
    col = lambda *names: F.coalesce(first_filled(*[F.col(n) for n in names]), F.lit(""))
    owner = first_filled(F.col("owner_name"), F.col("khatadar_name"), F.col("owner_0_name"))
    shown = owner if has_permission(role, "VIEW_PII") else F.when(owner.isNotNull(), mask_name(owner))
    return joined.select(
        "document_id",
        "filename",
        "doc_type",
        "status",
        "overall_confidence",
        col("ulpin").alias("ulpin"),
        col("survey_or_khasra_no", "survey_no", "khasra_no").alias("survey_no"),
        col("village").alias("village"),
        F.coalesce(shown, F.lit("Unknown")).alias("owner_name"),
        col("area_sqm", "plot_area_sqm", "plot_area_value").alias("area_sqm"),
        col("land_type", "land_class", "land_classification").alias("land_type"),
        "created_at",
    )


def export_geometry(rows: DataFrame, parcels: DataFrame) -> DataFrame:
    """Adds ord of the parcel: by land id, else by village and survey number; null when there is none.

    The OR is two equi-joins against hashed tables with one row per key: rows are not sorted and no table is sent whole to
    every task. Rows without a land id, and those without a survey number, are spread, not gathered in a task.
    """
    by_id = parcels.filter(F.col("ulpin") != "").groupBy("ulpin").agg(F.min("ord").alias("id_ord"))
    by_id = by_id.select(spread(F.col("ulpin"), "id_ord").alias("_id"), "id_ord")
    by_place = parcels.groupBy(
        F.lower(F.trim("village")).alias("_village"), F.trim("survey_no").alias("_survey")
    ).agg(F.min("ord").alias("place_ord"))
    # parcels without a survey number are few places; each meets all parts of the rows without one
    by_place = by_place.select("_village", F.explode(spread_over(F.col("_survey"))).alias("_survey"), "place_ord")
    keyed = rows.withColumns(
        {
            "_row_id": spread(F.col("ulpin"), "document_id"),
            "_row_village": F.lower(F.trim("village")),
            "_row_survey": spread(F.trim("survey_no"), "document_id"),
        }
    )
    joined = keyed.join(by_id.hint(HASHED), F.col("_row_id") == F.col("_id"), "left").join(
        by_place.hint(HASHED),
        (F.col("_row_village") == F.col("_village")) & (F.col("_row_survey") == F.col("_survey")),
        "left",
    )
    return joined.select(*rows.columns, F.least("id_ord", "place_ord").alias("ord"))


def linked_parcels(parcels: DataFrame, documents: DataFrame, fields: DataFrame, role: str) -> DataFrame:
    """Parcels with their digitized record and its owner; 'unlinked' when there is none.

    Of several documents with the survey number in the village, the smallest id is taken.
    """
    keyed = widen(
        fields, ["survey_or_khasra_no", "survey_no", "khasra_no", "village", "owner_name", "khatadar_name", "owner_0_name"]
    )
    survey = first_filled(F.col("survey_or_khasra_no"), F.col("survey_no"), F.col("khasra_no"))
    owner = first_filled(F.col("owner_name"), F.col("khatadar_name"), F.col("owner_0_name"))
    named = keyed.select(
        "document_id", survey.alias("_survey"), F.lower(F.trim("village")).alias("_village"), owner.alias("_owner")
    )
    first = named.filter(F.col("_survey").isNotNull()).groupBy("_village", "_survey").agg(F.min("document_id").alias("document_id"))
    record = first.join(named.select("document_id", "_owner"), "document_id").join(
        documents.select("document_id", "filename", "status", "overall_confidence", "doc_type"), "document_id"
    )
    joined = parcels.join(
        record,
        (F.lower(F.trim(parcels["village"])) == F.col("_village")) & (F.trim(parcels["survey_no"]) == F.col("_survey")),
        "left",
    )
    name = F.coalesce("_owner", F.lit("Government / Unknown"))
    shown = name if has_permission(role, "VIEW_PII") else mask_name(name)
    found = F.col("document_id").isNotNull()
    return joined.select(
        *[parcels[c] for c in parcels.columns],
        "document_id",
        F.when(found, shown).alias("recorded_owner"),
        F.when(found, F.col("status")).otherwise("unlinked").alias("verification_status"),
    )


def parcels_of_village(parcels: DataFrame, village: str | None = None) -> DataFrame:
    if village is None:
        return parcels
    return parcels.filter(F.lower(F.trim("village")) == village.strip().lower())


def supported_states(directory: DataFrame) -> DataFrame:
    return directory.select(F.initcap("state").alias("state")).distinct()
