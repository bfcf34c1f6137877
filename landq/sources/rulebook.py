"""The ten legal-consistency rules and their adjustable settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landq.sources.dictionaries import inline_table

SHARES = "RULE_SHARE_SUM_100"
HOLDING = "RULE_AREA_HOLDING_LIMIT"
CHRONOLOGY = "RULE_MUTATION_CHRONOLOGY"
CAPACITY = "RULE_PARTY_LEGAL_CAPACITY"
CONVERSION = "RULE_LAND_CLASS_CONVERSION_ORDER"
TENURE = "RULE_RESTRICTED_TENURE_TRANSFER"
DUPLICATE = "RULE_DUPLICATE_REGISTRY_DETECTION"
CEILING = "RULE_AGRICULTURAL_LAND_CEILING"
IDENTIFIER = "RULE_IDENTIFIER_FORMAT_CHECK"
HIERARCHY = "RULE_ADMIN_HIERARCHY_VALIDITY"

# fixed values: rule id, severity, document types it applies to ("all" = every type), default tolerance
RULES = [
    (SHARES, "critical", "all", 0.01),
    (HOLDING, "critical", "sale_deed,mutation_register,khatauni_7_12", 1.0),
    (CHRONOLOGY, "error", "mutation_register,sale_deed", None),
    (CAPACITY, "critical", "all", None),
    (CONVERSION, "error", "all", None),
    (TENURE, "critical", "sale_deed,mutation_register", None),
    (DUPLICATE, "critical", "all", None),
    (CEILING, "warn", "all", None),
    (IDENTIFIER, "warn", "all", None),
    (HIERARCHY, "error", "all", None),
]

# fixed values: land ceiling in hectares per state: irrigated, dry
CEILINGS = {
    "maharashtra": (7.28, 21.85),
    "uttar pradesh": (7.30, 18.25),
    "default": (7.28, 21.85),
}

# fixed values: identifier patterns
ULPIN_PATTERN = "^[A-Z0-9]{14}$"
SURVEY_PATTERN = "^[0-9]+([/\\\\-][0-9A-Za-z]+)?$"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    applies_to: tuple[str, ...]
    enabled: bool = True
    tolerance: float | None = None


@dataclass(frozen=True)
class RuleBook:
    """Settings as plan-time constants: thresholds fold into the filters that use them."""

    rules: dict[str, Rule]
    ceilings: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(CEILINGS))
    enforce_scope: bool = False

    @staticmethod
    def default() -> "RuleBook":
        return RuleBook(
            {r: Rule(r, sev, tuple(scope.split(",")), True, tol) for r, sev, scope, tol in RULES}
        )

    @staticmethod
    def from_table(rules: DataFrame) -> "RuleBook":
        """Reads a ``rules`` table. Repeated equal rows count once; a table that keeps a rule's older settings needs
        a ``ts`` column, whose latest row counts. Unknown, missing and ambiguous rules are errors.

        One row for each rule id reaches the driver, and only ids that are rules: the aggregate names the others.
        """
        settings = F.struct("severity", "applies_to", "enabled", "tolerance")
        known = [r[0] for r in RULES]
        listed = F.when(F.col("rule_id").isin(known), F.col("rule_id")).otherwise("?")
        order = F.col("ts") if "ts" in rules.columns else F.lit(0)
        newest = rules.select(listed.alias("rule_id"), F.col("rule_id").alias("_id"), order.alias("_ts"), settings.alias("s"))
        last = newest.groupBy("rule_id").agg(F.max("_ts").alias("_last"), F.min("_id").alias("_id"))
        chosen = newest.drop("_id").join(last, "rule_id").filter(F.col("_ts").eqNullSafe(F.col("_last")) | (F.col("rule_id") == "?"))
        found = chosen.groupBy("rule_id").agg(F.min("s").alias("s"), F.max("s").alias("t"), F.min("_id").alias("_id")).collect()
        problems = [f"unknown rule {r['_id']}" for r in found if r["rule_id"] == "?"]
        problems += [f"several settings for {r['rule_id']}" for r in found if r["rule_id"] != "?" and r["s"] != r["t"]]
        problems += [f"no settings for {k}" for k in known if k not in {r["rule_id"] for r in found}]
        if problems:
            raise ValueError("; ".join(problems))
        rows = [{"rule_id": r["rule_id"], **r["s"].asDict()} for r in found]
        return RuleBook(
            {
                r["rule_id"]: Rule(
                    r["rule_id"], r["severity"], tuple(r["applies_to"].split(",")), r["enabled"], r["tolerance"]
                )
                for r in rows
            }
        )

    def enabled(self, rule_id: str) -> bool:
        return rule_id in self.rules and self.rules[rule_id].enabled

    def severity(self, rule_id: str) -> str:
        return self.rules[rule_id].severity

    def tolerance(self, rule_id: str, default: float) -> float:
        value = self.rules[rule_id].tolerance if rule_id in self.rules else None
        return default if value is None else value

    def tuned(self, rule_id: str, **changes: object) -> "RuleBook":
        return replace(self, rules={**self.rules, rule_id: replace(self.rules[rule_id], **changes)})

    def only(self, *rule_ids: str) -> "RuleBook":
        """All other rules disabled, so that a plan leaves them out."""
        return replace(self, rules={k: replace(r, enabled=r.enabled and k in rule_ids) for k, r in self.rules.items()})

    def in_scope(self, rule_id: str, document_type: Column) -> Column:
        """Scope test; off by default, because scopes are declared but not applied by the rules."""
        scope = self.rules[rule_id].applies_to
        if not self.enforce_scope or "all" in scope:
            return F.lit(True)
        return document_type.isin(*scope)


def rules_table(spark: SparkSession) -> DataFrame:
    rows = [(r, sev, scope, True, tol) for r, sev, scope, tol in RULES]
    return inline_table(spark, ["rule_id", "severity", "applies_to", "enabled", "tolerance"], rows)


def apply_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Latest non-null setting per rule wins; the audit of changes is ``override_audit``.

    ``overrides``: rule_id, ts, id, enabled, tolerance.
    """
    when = F.struct("ts", "id")
    latest = overrides.groupBy("rule_id").agg(
        F.max_by("enabled", F.when(F.col("enabled").isNotNull(), when)).alias("new_enabled"),
        F.max_by("tolerance", F.when(F.col("tolerance").isNotNull(), when)).alias("new_tolerance"),
    )
    return rules.join(latest, "rule_id", "left").select(
        "rule_id",
        "severity",
        "applies_to",
        F.coalesce("new_enabled", "enabled").alias("enabled"),
        F.coalesce("new_tolerance", "tolerance").alias("tolerance"),
    )


def override_audit(overrides: DataFrame) -> DataFrame:
    """One audit event per settings change."""
    return overrides.select(
        F.lit("RULE_UPDATE").alias("action"),
        F.col("rule_id").alias("entity_id"),
        F.to_json(F.struct("enabled", "tolerance")).alias("details"),
        F.col("ts"),
    )
