"""Personal-data masking by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landq.functions.text import field_kind, mask_field, mask_name
from landq.sources.dictionaries import has_permission, role_aliases, role_permissions

NOTE = "pii_masked:restricted_access"


def resolve_permissions(users: DataFrame, role: str = "role") -> DataFrame:
    """user rows x permissions of their (aliased) role; unknown roles have none. Role tables are constants."""
    spark = users.sparkSession
    named = role_aliases(spark).withColumnRenamed("role", "canonical_role")
    joined = users.join(F.broadcast(named), F.lower(users[role]) == named["alias"], "left").drop("alias")
    rights = role_permissions(spark).withColumnRenamed("role", "canonical_role")
    return joined.join(F.broadcast(rights), "canonical_role").select(*users.columns, "canonical_role", "permission")


def mask_fields(fields: DataFrame, role: str) -> DataFrame:
    """Fields as a role may see them: value and raw text of personal fields masked and marked."""
    if has_permission(role, "VIEW_PII"):
        return fields
    personal = field_kind(F.col("field_name")).isNotNull()
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return fields.withColumns(
        {
            "value": mask_field(F.col("field_name"), F.col("value")),
            "raw_text": mask_field(F.col("field_name"), F.col("raw_text")),
            "flags": F.when(personal, F.concat(flags, F.array(F.lit(NOTE)))).otherwise(flags),
        }
    )


def mask_owners(owners: DataFrame, role: str, name: str = "name") -> DataFrame:
    if has_permission(role, "VIEW_PII"):
        return owners
    return owners.withColumn(name, mask_name(F.col(name)))
