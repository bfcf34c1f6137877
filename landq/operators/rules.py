"""Legal-consistency rules. Each takes record tables and returns validation-result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.functions.text import first_filled, parse_date, parse_share, round_to, to_number
from landq.operators.ordered import hot_keys, lagged
from landq.operators.records import union_all
from landq.sources import rulebook as rb
from landq.sources.dictionaries import LEGAL_DISCLAIMER, admin_hierarchy
from landq.sources.rulebook import RuleBook

YES_DECEASED = ["true", "yes", "मृत"]
YES_MINOR = ["true", "yes", "नाबालिग", "अल्पवयीन"]
NON_AGRICULTURAL = ["non_agricultural", "commercial", "na"]
SHARE_TYPE = "decimal(28,12)"
ANCHOR = 4
MANY_NAMES = 1_000
#: What meets documents by id is met by a table of these: nothing is sorted, so a task holds its documents' few columns only,
#: however many rows its shuffled bytes, which Spark deals them by, turn out to be.
HASHED = "shuffle_hash"


def _evidence(**items: Column) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _finding(
    rule: str,
    name: Column | str,
    severity: Column | str,
    message: Column | str,
    evidence: Column,
    status: Column | str = "failed",
) -> Column:
    """A validation result without its document."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule).alias("rule_id"),
        as_col(name).alias("rule_name"),
        as_col(severity).alias("severity"),
        as_col(status).alias("status"),
        as_col(message).alias("message"),
        evidence.alias("evidence"),
        F.lit(LEGAL_DISCLAIMER).alias("disclaimer"),
    )


RESULT = ["rule_id", "rule_name", "severity", "status", "message", "evidence", "disclaimer"]


def _results(df: DataFrame, *rules: Column | tuple[Column, Column]) -> DataFrame:
    """Result rows of one finding, or of (condition, finding) pairs over the same rows, in one pass.

    Of the pairs only the places of those that hold are exploded. Each column is made from its own expressions and not
    taken out of a struct: what a query doesn't ask for, messages above all, is never put together.
    """
    if len(rules) == 1 and isinstance(rules[0], Column):
        return df.select("document_id", *[rules[0].getField(name).alias(name) for name in RESULT])
    holding = F.array_compact(F.array(*[F.when(condition, F.lit(at)) for at, (condition, _) in enumerate(rules)]))
    found = df.withColumn("_at", F.explode(holding))

    def column(name: str) -> Column:
        values = [finding.getField(name) for _, finding in rules]
        chosen = F.when(F.col("_at") == 0, values[0])
        for at, value in enumerate(values[1:], start=1):
            chosen = chosen.when(F.col("_at") == at, value)
        return chosen.alias(name)

    return found.select("document_id", *[column(name) for name in RESULT])


# ---------------------------------------------------------------- shares


def share_totals(owners: DataFrame) -> DataFrame:
    """document_id, total_share, discrepancy, owner_count. Exact decimal sums, so order does not matter."""
    share = parse_share(F.col("share")).cast(SHARE_TYPE)
    totals = owners.groupBy("document_id").agg(
        F.sum(share).cast("double").alias("total_share"), F.count(F.lit(1)).alias("owner_count")
    )
    return totals.withColumn("discrepancy", F.abs(F.col("total_share") - 1.0))


def share_sum(owners: DataFrame, book: RuleBook) -> DataFrame:
    totals = share_totals(owners)
    bad = F.col("discrepancy") > book.tolerance(rb.SHARES, 0.01)
    message = F.when(
        bad,
        F.format_string(
            "Shares add up to %.4f instead of 1, off by %.4f over %d owner rows.",
            "total_share", "discrepancy", "owner_count",
        ),
    ).otherwise(
        F.format_string("Shares add up to 1, off by %.4f.", "discrepancy")
    )
    return _results(totals, _finding(
        rb.SHARES,
        F.lit("Shares Add Up"),
        F.when(bad, F.lit(book.severity(rb.SHARES))).otherwise("info"),
        message,
        _evidence(
            total_share=F.col("total_share"), discrepancy=F.col("discrepancy"), owners=F.col("owner_count")
        ),
        F.when(bad, "failed").otherwise("passed"),
    ))


def share_evidence(owners: DataFrame, results: DataFrame) -> DataFrame:
    """The raw shares behind each failed share sum, one row per owner."""
    failed = results.filter((F.col("rule_id") == rb.SHARES) & (F.col("status") == "failed"))
    return owners.select("document_id", "pos", "share_raw").join(
        failed.select("document_id"), "document_id", "left_semi"
    )


# ---------------------------------------------------------------- areas


def area_excess(records: DataFrame, mutations: DataFrame, book: RuleBook) -> DataFrame:
    """First mutation of each document that moves more land than the holding."""
    factor = 1.0 + book.tolerance(rb.HOLDING, 1.0) / 100.0
    moved = mutations.select(
        "document_id", "idx", to_number(F.col("transferred_area").cast("string")).alias("transferred_area")
    ).filter(F.col("transferred_area").isNotNull())
    holdings = records.select("document_id", "holding_sqm").filter(F.col("holding_sqm") != 0)
    over = moved.join(holdings.hint(HASHED), "document_id").filter(F.col("transferred_area") > F.col("holding_sqm") * factor)
    first = over.groupBy("document_id").agg(
        F.min(F.struct("idx", "transferred_area", "holding_sqm")).alias("m")
    )
    return first.select("document_id", "m.*")


def area_holding(records: DataFrame, mutations: DataFrame, book: RuleBook) -> DataFrame:
    over = area_excess(records, mutations, book)
    excess = F.col("transferred_area") - F.col("holding_sqm")
    return _results(over, _finding(
        rb.HOLDING,
        F.lit("Moved Area within Holding"),
        F.lit(book.severity(rb.HOLDING)),
        F.format_string(
            "A mutation moves %.2f out of a holding of %.2f: %.2f too much, %.1f%% of the holding.",
            F.col("transferred_area"), F.col("holding_sqm"), excess, excess / F.col("holding_sqm") * 100.0,
        ),
        _evidence(
            transferred_area=F.col("transferred_area"), holding_area=F.col("holding_sqm"), mutation_index=F.col("idx")
        ),
    ))


# ---------------------------------------------------------------- dates


def dated_mutations(records: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutations with parsed dates; the deed date is the mutation's own, else the document's."""
    deeds = records.select(
        "document_id", F.col("reg_date").alias("document_reg_date"), parse_date(F.col("reg_date")).alias("document_deeded_on")
    )
    # each text is parsed where it stands, those of a document once and not with each of its mutations
    parsed = mutations.withColumns(
        {"mutated_on": parse_date(F.col("mutation_date")), "deeded_on": parse_date(F.col("registration_date"))}
    )
    own = F.col("registration_date") != ""
    return parsed.join(deeds.hint(HASHED), "document_id", "left").withColumns(
        {
            "deed_text": first_filled(F.col("registration_date"), F.col("document_reg_date")),
            "deeded_on": F.when(own, F.col("deeded_on")).otherwise(F.col("document_deeded_on")),
        }
    )


def chronology(records: DataFrame, mutations: DataFrame, book: RuleBook, as_of: str) -> DataFrame:
    """Mutation dates in the future of ``as_of`` or before the deed; up to two rows per mutation."""
    dated = dated_mutations(records, mutations)
    kind = F.array_compact(
        F.array(
            F.when(F.col("mutated_on") > F.lit(as_of).cast("date"), F.lit("future")),
            F.when(F.col("mutated_on") < F.col("deeded_on"), F.lit("early")),
        )
    )
    found = dated.withColumn("kind", F.explode(kind))
    early = F.col("kind") == "early"
    return _results(found, _finding(
        rb.CHRONOLOGY,
        F.when(early, "Mutation before Deed").otherwise("Mutation to Come"),
        F.when(early, F.lit(book.severity(rb.CHRONOLOGY))).otherwise("error"),
        F.when(
            early,
            F.format_string(
                "Mutated on %s, before the deed of %s.",
                "mutation_date", "deed_text",
            ),
        ).otherwise(F.format_string("Mutated on %s, a day still to come.", "mutation_date")),
        _evidence(
            mutation_date=F.col("mutation_date"),
            registration_date=F.when(early, F.col("deed_text")),
            mutation_no=F.col("mutation_no"),
            mutation_index=F.col("idx"),
        ),
    ))


def numbering_gaps(mutations: DataFrame) -> DataFrame:
    """Mutations whose number does not follow the one before it in date order."""
    numbered = mutations.select(
        "document_id",
        "idx",
        parse_date(F.col("mutation_date")).alias("mutated_on"),
        F.regexp_extract("mutation_no", r"([0-9]+)$", 1).try_cast("long").alias("number"),
    ).filter(F.col("mutated_on").isNotNull() & F.col("number").isNotNull())
    order = ["mutated_on", "number", "idx"]
    pairs = lagged(
        numbered, ["document_id"], order, [F.col("mutated_on")], {"previous": "number"}, counted=mutations
    )
    return pairs.filter(F.col("number") - F.col("previous") != 1)


# ---------------------------------------------------------------- parties


def _is(column: str, yes: list[str]) -> Column:
    return F.lower(F.col(column).cast("string")).isin(yes)


def deceased_transferors(owners: DataFrame, mutations: DataFrame) -> DataFrame:
    """document_id, party_name, mutation_no, idx where a deceased owner's name is within the transferor.

    Names and transferors are made distinct per document first. Documents with very many deceased names
    are matched on the name's first letters as well, so that they do not pair all with all.
    """
    names = (
        owners.filter(_is("is_deceased", YES_DECEASED) & (F.col("name") != ""))
        .select("document_id", F.col("name").alias("party_name"))
        .distinct()
    )
    transfers = mutations.filter(F.col("from_party") != "")
    sellers = transfers.select("document_id", "from_party").distinct()
    inside = F.lower("from_party").contains(F.lower("party_name"))
    hot = hot_keys(owners, ["document_id"], MANY_NAMES)
    if hot is None:
        matched = names.join(sellers, "document_id").filter(inside)
    else:
        plain = names.join(hot, "document_id", "left_anti").join(sellers, "document_id").filter(inside)
        anchored = names.join(hot, "document_id", "left_semi").withColumn(
            "anchor", F.left(F.lower("party_name"), F.lit(ANCHOR))
        )
        grams = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length("from_party")),
                lambda at: F.transform(
                    F.sequence(F.lit(1), F.lit(ANCHOR)), lambda n: F.substring(F.lower("from_party"), at, n)
                ),
            )
        )
        pieces = sellers.join(hot, "document_id", "left_semi").withColumn(
            "anchor", F.explode(F.array_distinct(grams))
        )
        dense = anchored.join(pieces, ["document_id", "anchor"]).filter(inside).drop("anchor")
        matched = plain.unionByName(dense.select(*plain.columns))
    return matched.join(
        transfers.select("document_id", "from_party", "mutation_no", "idx"), ["document_id", "from_party"]
    ).select("document_id", "party_name", "mutation_no", "idx")


def unguarded_minors(owners: DataFrame) -> DataFrame:
    no_guardian = F.coalesce(F.col("father_husband"), F.lit("")) == ""
    return owners.filter(_is("is_minor", YES_MINOR) & no_guardian)


def party_capacity(owners: DataFrame, mutations: DataFrame, book: RuleBook) -> DataFrame:
    dead = deceased_transferors(owners, mutations)
    minors = unguarded_minors(owners)
    return _results(dead, _finding(
        rb.CAPACITY,
        F.lit("Deceased Transferor"),
        F.lit("critical"),
        F.format_string(
            "Deceased owner '%s' gives land away in mutation %s.", "party_name", "mutation_no"
        ),
        _evidence(party_name=F.col("party_name"), mutation_no=F.col("mutation_no")),
    )).unionByName(
        _results(minors, _finding(
            rb.CAPACITY,
            F.lit("Minor without Guardian"),
            F.lit("warn"),
            F.format_string("Minor '%s' has no guardian on record.", "name"),
            _evidence(party_name=F.col("name"), mutation_no=F.lit(None)),
    ))
    )


# ---------------------------------------------------------------- rules on the record alone
#
# Each is a (condition, finding) pair over the columns of one record, so that record_rules can apply all of
# them in a single pass over the records.


def _conversion(book: RuleBook) -> tuple[Column, Column]:
    land = F.lower("land_class")
    missing = F.coalesce(F.col("na_order_ref"), F.lit("")) == ""
    return land.isin(NON_AGRICULTURAL) & missing, _finding(
        rb.CONVERSION,
        "Conversion Order Missing",
        book.severity(rb.CONVERSION),
        F.format_string(
            "Land class '%s' needs a conversion order and the record names none.", land
        ),
        _evidence(land_class=land),
    )


def conversion_order(records: DataFrame, book: RuleBook) -> DataFrame:
    condition, finding = _conversion(book)
    return _results(records.filter(condition), finding)


def _tenure(book: RuleBook) -> tuple[Column, Column]:
    tenure = F.lower("ownership_type")
    missing = F.coalesce(F.col("tenure_perm_ref"), F.lit("")) == ""
    return tenure.rlike("restricted|tribal|inam") & missing, _finding(
        rb.TENURE,
        "Transfer Permission Missing",
        book.severity(rb.TENURE),
        F.format_string(
            "Tenure '%s' passes on with permission only and the record names none.", tenure
        ),
        _evidence(tenure_type=tenure),
    )


def restricted_tenure(records: DataFrame, book: RuleBook) -> DataFrame:
    condition, finding = _tenure(book)
    return _results(records.filter(condition), finding)


def ceiling_for(book: RuleBook, state: Column, land_class: Column) -> Column:
    """Hectares allowed for a state and a canonical class; only 'irrigated' has the lower ceiling."""

    def by_state(at: int) -> Column:
        limits = F.create_map(
            *[F.lit(x) for s, pair in book.ceilings.items() if s != "default" for x in (s, pair[at])]
        )
        return F.coalesce(F.try_element_at(limits, F.lower(state)), F.lit(book.ceilings["default"][at]))

    return F.when(F.lower(land_class) == "irrigated", by_state(0)).otherwise(by_state(1))


def over_ceiling(records: DataFrame, book: RuleBook) -> DataFrame:
    limited = records.withColumn("ceiling_ha", ceiling_for(book, F.col("state"), F.col("land_class")))
    return limited.filter(F.col("holding_ha") > F.col("ceiling_ha"))


def owner_over_ceiling(records: DataFrame, book: RuleBook) -> DataFrame:
    """Aggregate reading: all holdings of one owner in one state, per ceiling kind."""
    held = records.groupBy(
        "owner_id",
        F.lower("state").alias("state"),
        F.when(F.lower("land_class") == "irrigated", "irrigated").otherwise("dry").alias("land_class"),
    ).agg(F.sum(F.col("holding_ha").cast("decimal(28,8)")).cast("double").alias("holding_ha"))
    return over_ceiling(held, book)


def _ceiling(book: RuleBook) -> tuple[Column, Column]:
    ceiling = ceiling_for(book, F.col("state"), F.col("land_class"))
    return F.col("holding_ha") > ceiling, _finding(
        rb.CEILING,
        "Holding above Ceiling",
        book.severity(rb.CEILING),
        F.format_string(
            "The holding has %.2f ha where %.2f ha are allowed.", F.col("holding_ha"), ceiling
        ),
        _evidence(holding_ha=F.col("holding_ha"), ceiling_ha=ceiling, state=F.lower("state")),
    )


def land_ceiling(records: DataFrame, book: RuleBook) -> DataFrame:
    condition, finding = _ceiling(book)
    return _results(records.filter(condition), finding)


def bad_identifiers(records: DataFrame) -> DataFrame:
    """document_id, field_name, value for land ids and survey numbers of the wrong form."""
    ulpin, survey = F.trim("ulpin"), F.trim("survey_no")
    found = F.array_compact(
        F.array(
            F.when(
                (F.col("ulpin") != "") & ~ulpin.rlike(rb.ULPIN_PATTERN),
                F.struct(F.lit("ulpin").alias("field_name"), ulpin.alias("value")),
            ),
            F.when(
                (F.col("survey_no") != "") & ~survey.rlike(rb.SURVEY_PATTERN),
                F.struct(F.lit("survey_no").alias("field_name"), survey.alias("value")),
            ),
        )
    )
    return records.select("document_id", F.explode(found).alias("f")).select("document_id", "f.*")


def _identifier(book: RuleBook) -> tuple[Column, Column]:
    ulpin = F.trim("ulpin")
    return (F.col("ulpin") != "") & ~ulpin.rlike(rb.ULPIN_PATTERN), _finding(
        rb.IDENTIFIER,
        "Land Id Malformed",
        book.severity(rb.IDENTIFIER),
        F.format_string("Land id '%s' is not 14 capital letters and digits.", ulpin),
        _evidence(ulpin=ulpin),
    )


def identifier_format(records: DataFrame, book: RuleBook) -> DataFrame:
    condition, finding = _identifier(book)
    return _results(records.filter(condition), finding)


def hierarchy_check(records: DataFrame) -> DataFrame:
    """Adds failed_level: state, district, tehsil, village or null. The directory is a constant table."""
    spark = records.sparkSession
    directory = admin_hierarchy(spark)
    levels = ["state", "district", "tehsil", "village"]
    keyed = records.withColumns({f"_{c}": F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in levels})
    failed = None
    for depth, level in enumerate(levels, start=1):
        path = levels[:depth]
        known = directory.select(*[F.col(c).alias(f"_{c}") for c in path]).distinct().withColumn(f"_has_{level}", F.lit(True))
        keyed = keyed.join(F.broadcast(known), [f"_{c}" for c in path], "left")
        miss = F.col(f"_has_{level}").isNull()
        failed = F.when(miss, level) if failed is None else failed.when(miss, level)
    return keyed.withColumn("failed_level", failed).select(*records.columns, "failed_level")


def hierarchy_reason() -> Column:
    level = F.col("failed_level")
    return (
        F.when(level == "state", F.format_string("No state '%s' in the directory", "state"))
        .when(level == "district", F.format_string("No district '%s' in state '%s'", "district", "state"))
        .when(
            level == "tehsil",
            F.format_string("No tehsil '%s' in district '%s', %s", "tehsil", "district", "state"),
        )
        .when(
            level == "village",
            F.format_string("No village '%s' in tehsil '%s', %s", "village", "tehsil", "district"),
        )
        .otherwise("All levels known")
    )


def _hierarchy(book: RuleBook) -> tuple[Column, Column]:
    """Over the columns of hierarchy_check; passes are reported as well."""
    bad = F.col("failed_level").isNotNull()
    return F.lit(True), _finding(
        rb.HIERARCHY,
        F.when(bad, "Place Unknown").otherwise("Place Known"),
        F.when(bad, F.lit(book.severity(rb.HIERARCHY))).otherwise("info"),
        F.when(bad, F.concat(F.lit("Place not in the directory: "), hierarchy_reason())).otherwise(
            "Village, tehsil, district and state are in the directory."
        ),
        _evidence(
            state=F.col("state"),
            district=F.col("district"),
            tehsil=F.col("tehsil"),
            village=F.col("village"),
            reason=F.when(bad, hierarchy_reason()),
        ),
        F.when(bad, "failed").otherwise("passed"),
    )


def admin_validity(records: DataFrame, book: RuleBook) -> DataFrame:
    return _results(hierarchy_check(records), _hierarchy(book)[1])


RECORD_RULES = {
    rb.CONVERSION: _conversion,
    rb.TENURE: _tenure,
    rb.CEILING: _ceiling,
    rb.IDENTIFIER: _identifier,
    rb.HIERARCHY: _hierarchy,
}


def record_rules(records: DataFrame, book: RuleBook) -> DataFrame | None:
    """All enabled rules that need one record only: one scan, no shuffle."""
    rules = [rule for rule in RECORD_RULES if book.enabled(rule)]
    if not rules:
        return None
    checked = hierarchy_check(records) if rb.HIERARCHY in rules else records
    return _results(checked, *[RECORD_RULES[rule](book) for rule in rules])


# ---------------------------------------------------------------- duplicates


def conflicts(records: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that share a key with another one, and the first such other document.

    Two aggregations (smallest and second smallest id per key) combine before the shuffle, so a key that
    many documents share never gathers in one task.
    """
    filled = records.select("document_id", *keys)
    for k in keys:
        filled = filled.filter(F.coalesce(F.col(k), F.lit("")) != "")
    firsts = (
        filled.groupBy(*keys)
        .agg(F.min("document_id").alias("first_id"), F.max("document_id").alias("last_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("first_id") != F.col("last_id"))
        .drop("last_id")
    )
    shared = filled.join(firsts.hint(HASHED), keys)
    seconds = (
        shared.filter(F.col("document_id") > F.col("first_id"))
        .groupBy(*keys)
        .agg(F.min("document_id").alias("second_id"))
    )
    other = F.when(F.col("document_id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    return shared.join(seconds.hint(HASHED), keys).select("document_id", *keys, "copies", other.alias("conflicting_id"))


def registration_conflicts(records: DataFrame) -> DataFrame:
    return conflicts(records, ["reg_no"])


def holding_conflicts(records: DataFrame) -> DataFrame:
    """Second reading of the rule: the same survey and hissa in the same village."""
    keyed = records.select(
        "document_id",
        F.lower(F.trim("village")).alias("village"),
        F.trim("survey_no").alias("survey_no"),
        F.coalesce(F.trim("sub_division"), F.lit("-")).alias("sub_division"),
    )
    return conflicts(keyed, ["village", "survey_no", "sub_division"])


def duplicate_registry(records: DataFrame, book: RuleBook) -> DataFrame:
    return _results(registration_conflicts(records), _finding(
        rb.DUPLICATE,
        F.lit("Registration Number Reused"),
        F.lit(book.severity(rb.DUPLICATE)),
        F.format_string(
            "Registration number '%s' is that of document %s already.",
            F.col("reg_no"), F.col("conflicting_id").cast("string"),
        ),
        _evidence(conflicting_doc_id=F.col("conflicting_id"), reg_no=F.col("reg_no")),
    ))


# ---------------------------------------------------------------- all rules


def validate(
    records: DataFrame, owners: DataFrame, mutations: DataFrame, book: RuleBook, as_of: str
) -> DataFrame:
    """Rows of every enabled rule. Disabled rules are left out of the plan."""
    runs = {
        rb.SHARES: lambda: share_sum(owners, book),
        rb.HOLDING: lambda: area_holding(records, mutations, book),
        rb.CHRONOLOGY: lambda: chronology(records, mutations, book, as_of),
        rb.CAPACITY: lambda: party_capacity(owners, mutations, book),
        rb.DUPLICATE: lambda: duplicate_registry(records, book),
    }
    found = [run() for rule, run in runs.items() if book.enabled(rule)]
    alone = record_rules(records, book)
    results = union_all(found if alone is None else [*found, alone])
    return in_scope(results, records, book)


def in_scope(results: DataFrame, records: DataFrame, book: RuleBook) -> DataFrame:
    """Keep results of rules that apply to the document's type, when the rule book enforces scopes."""
    if not book.enforce_scope:
        return results
    typed = results.join(records.select("document_id", "document_type").hint(HASHED), "document_id")
    keep = F.lit(False)
    for rule in book.rules:
        keep = keep | ((F.col("rule_id") == rule) & book.in_scope(rule, F.col("document_type")))
    return typed.filter(keep).drop("document_type")


def summarize(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Per document: evaluated and failed rows, score, failed rules in rule order (ten at most)."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rb.RULES) for x in (r[0], i)])
    failed = F.col("status") == "failed"
    per_rule = results.groupBy("document_id", "rule_id").agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if(failed).alias("failed")
    )
    rules = F.collect_list(
        F.when(F.col("failed") > 0, F.struct(F.try_element_at(order, F.col("rule_id")).alias("o"), F.col("rule_id").alias("r")))
    )
    per_doc = per_rule.groupBy("document_id").agg(
        F.sum("evaluated").alias("evaluated"),
        F.sum("failed").alias("failed"),
        F.transform(F.array_sort(rules), lambda x: x["r"]).alias("failed_rules"),
    )
    score = 1.0 - F.try_divide(F.col("failed").cast("double"), F.col("evaluated").cast("double"))
    return (
        documents.select("document_id")
        .join(per_doc, "document_id", "left")
        .select(
            "document_id",
            F.coalesce("evaluated", F.lit(0)).alias("evaluated"),
            F.coalesce("failed", F.lit(0)).alias("failed"),
            round_to(F.greatest(F.lit(0.0), F.coalesce(score, F.lit(1.0))), 3).alias("score"),
            F.coalesce("failed_rules", F.array().cast("array<string>")).alias("failed_rules"),
        )
    )
