"""Ownership timeline, title continuity and party graph of parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions.text import first_filled, parse_date
from landq.operators.ordered import lagged, ranked

UNDATED = "1970-01-01"
ORIGIN = "Prior State/Ancestor"
BUYER = "Purchaser"
ROLES = ["current_owner", "prior_owner", "intermediate_party"]


def _dated(mutations: DataFrame) -> DataFrame:
    day = F.coalesce(parse_date(F.col("mutation_date")), F.lit(UNDATED).cast("date"))
    return mutations.withColumn("on_date", day)


def _day_splits(df: DataFrame) -> list[Column]:
    """Long timelines split by day and, within one day, by ranges of document ids."""
    if dict(df.dtypes)["document_id"] in ("bigint", "int"):
        return [F.col("on_date"), F.shiftright("document_id", 20)]
    return [F.col("on_date"), F.substring("document_id", 1, 2)]


ORDER = ["on_date", "document_id", "idx", "mutation_no"]


def timeline(mutations: DataFrame) -> DataFrame:
    """Mutations of each parcel numbered by date, with the line shown to a reader.

    ``mutations``: parcel_id, document_id, idx, mutation_no, mutation_date, mutation_type, from_party,
    to_party, transferred_area, order_ref.
    """
    dated = _dated(mutations)
    lined = dated.withColumns(
        {
            "action": F.format_string(
                "%s transfer from '%s' to '%s'",
                F.initcap(F.coalesce("mutation_type", F.lit("sale"))),
                first_filled(F.col("from_party"), F.lit(ORIGIN)),
                first_filled(F.col("to_party"), F.lit(BUYER)),
            ),
            "extent": F.when(
                F.coalesce(F.col("transferred_area").cast("string").try_cast("double"), F.lit(0.0)) != 0,
                F.concat(F.col("transferred_area").cast("string"), F.lit(" sq m")),
            ).otherwise("Full holding"),
            "order_ref": F.coalesce("order_ref", F.lit("Revenue Certified")),
        }
    )
    return ranked(lined, ["parcel_id"], ORDER, _day_splits(lined), "rn")


def missing_roots(mutations: DataFrame) -> DataFrame:
    """Parcels whose first mutation names no transferor: the smallest row per parcel, no window."""
    dated = _dated(mutations)
    first = dated.groupBy("parcel_id").agg(
        F.min(F.struct(*ORDER, F.coalesce("from_party", F.lit("")).alias("from_party"))).alias("m")
    )
    return first.filter(F.col("m.from_party") == "").select(
        "parcel_id",
        F.col("m.document_id").alias("document_id"),
        F.lit("Root grant or antecedent title holder missing in initial mutation.").alias("gap_note"),
    )


def title_breaks(mutations: DataFrame, sender: str = "from_party", receiver: str = "to_party") -> DataFrame:
    """Mutations whose transferor is not the party the parcel last went to."""
    dated = _dated(mutations)
    chained = lagged(dated, ["parcel_id"], ORDER, _day_splits(dated), {"last_holder": receiver})
    return chained.filter(F.col("last_holder").isNotNull() & ~F.col("last_holder").eqNullSafe(F.col(sender)))


def party_nodes(owners: DataFrame, mutations: DataFrame) -> DataFrame:
    """party, role: every party of a parcel once, the first of current owner, transferor, transferee."""
    role = lambda df, column, at: df.select(
        "parcel_id", F.col(column).alias("party"), F.lit(at).alias("role_ord")
    )
    sent = mutations.withColumn("from_party", first_filled(F.col("from_party"), F.lit(ORIGIN)))
    got = mutations.withColumn("to_party", first_filled(F.col("to_party"), F.lit(BUYER)))
    parties = (
        role(owners, "name", 0)
        .unionByName(role(sent, "from_party", 1))
        .unionByName(role(got, "to_party", 2))
        .filter(F.col("party").isNotNull())
    )
    first = parties.groupBy("parcel_id", "party").agg(F.min("role_ord").alias("role_ord"))
    names = F.array(*[F.lit(r) for r in ROLES])
    return first.select("parcel_id", "party", F.get(names, F.col("role_ord")).alias("role"))


def transfer_links(mutations: DataFrame) -> DataFrame:
    """Directed links of the graph."""
    return mutations.select(
        "parcel_id",
        first_filled(F.col("from_party"), F.lit(ORIGIN)).alias("source"),
        first_filled(F.col("to_party"), F.lit(BUYER)).alias("target"),
        "mutation_no",
        first_filled(F.col("mutation_date"), F.lit("Undated")).alias("mutation_date"),
        F.coalesce("mutation_type", F.lit("sale")).alias("type"),
        "transferred_area",
    )
