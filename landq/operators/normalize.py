"""Regional normalization: areas, land classes, field labels, names, document types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landq.functions import similarity
from landq.functions.text import clean_label, round_to, sorted_words, strip_honorifics, transliterate
from landq.sources.dictionaries import FIELD_LABELS, LAND_CLASSES, inline_table, state_factors, unit_synonyms

FUZZY_CLASS = 88.0
FUZZY_LABEL = 80.0
SAME_NAME = 75.0
SHORTEST_FUZZY = 4


def _looked_up(df: DataFrame, pairs: dict[str, str], out: str, *keys: Column) -> DataFrame:
    """Adds the value of the first of the keys that is in a fixed dictionary, by broadcast joins on constant tables."""
    found = []
    for i, key in enumerate(keys):
        table = inline_table(df.sparkSession, [f"_key{i}", f"_found{i}"], list(pairs.items()))
        asked = F.when(F.coalesce(*found).isNull(), key) if found else key
        df = df.join(F.broadcast(table), asked == F.col(f"_key{i}"), "left").drop(f"_key{i}")
        found.append(F.col(f"_found{i}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"_found{i}" for i in range(len(keys))])


def _spread(key: Column, *ids: str) -> Column:
    """A join key that keeps rows without one apart instead of in a single partition."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(*ids).cast("string")))


def convert_area(df: DataFrame, value: str, unit: str, state: str) -> DataFrame:
    """Adds area_sqm, area_hectares, area_flags. Unit tables are constants of a few dozen rows."""
    spark = df.sparkSession
    units = F.broadcast(unit_synonyms(spark).withColumnsRenamed({"spelling": "_spelling", "unit": "_unit"}))
    factors = F.broadcast(state_factors(spark).withColumnsRenamed({"unit": "_f_unit", "state_key": "_state"}))
    keyed = df.withColumns(
        {
            "_key": F.regexp_replace(F.lower(F.trim(F.col(unit))), r"\.+$", ""),
            "_place": F.lower(F.trim(F.col(state))),
        }
    )
    joined = keyed.join(units, F.col("_key") == F.col("_spelling"), "left").join(
        factors, (F.col("_unit") == F.col("_f_unit")) & (F.col("_place") == F.col("_state")), "left"
    )
    middle = (F.col("min_sqm") + F.col("max_sqm")) / 2.0
    usable = F.col(value) > 0
    sqm = F.col(value) * F.coalesce("sqm_factor", "state_factor", middle, F.lit(1.0))
    hectares = F.when(F.col("_unit").isNull(), F.col(value)).otherwise(sqm) / 10000.0
    flag = (
        F.when(~F.coalesce(usable, F.lit(False)), F.lit("invalid_or_zero_area"))
        .when(F.col("sqm_factor").isNotNull(), F.concat(F.lit("converted_unit:"), unit, F.lit("->"), "_unit"))
        .when(
            F.col("state_factor").isNotNull(),
            F.concat(
                F.lit("state_aware_conversion:"), "_unit", F.lit("_in_"), "_place", F.lit(":"),
                F.col("state_factor").cast("string"), F.lit("sqm"),
            ),
        )
        .when(
            F.col("_unit").isNotNull(),
            F.concat(
                F.lit("warning:state_context_required_for_"), "_unit", F.lit(":range=["),
                round_to(F.col(value) * F.col("min_sqm"), 2).cast("string"), F.lit(","),
                round_to(F.col(value) * F.col("max_sqm"), 2).cast("string"), F.lit("]sqm"),
            ),
        )
        .otherwise(F.concat(F.lit("unmapped_area_unit:"), F.coalesce(F.col(unit), F.lit(""))))
    )
    return joined.select(
        *df.columns,
        F.when(usable, round_to(sqm, 4)).alias("area_sqm"),
        F.when(usable, round_to(hectares, 6)).alias("area_hectares"),
        F.array(flag).alias("area_flags"),
    )


def _per_value(
    df: DataFrame, raw: str, id_column: str, open_: Column, answer: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Joins back what ``answer`` adds to the distinct values of a column: each value is worked out once.

    Only rows that are still ``open_`` ask. The others are spread evenly: however common a settled value is, it is no hot key.
    """
    asked = F.when(open_, F.col(raw))
    values = df.select(asked.alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    keyed = df.withColumn("_value", _spread(asked, id_column))
    return keyed.join(answer(values), "_value", "left").drop("_value")


def normalize_land_class(df: DataFrame, raw: str, id_column: str) -> DataFrame:
    """Adds land_class and class_flag. Exact spellings of all classes come before any fuzzy one."""
    exact = {s.lower(): c for c, names in LAND_CLASSES.items() for s in [c, *names]}
    fuzzy = [(c, s.lower()) for c, names in LAND_CLASSES.items() for s in names if len(s) >= SHORTEST_FUZZY]
    pick = similarity.best_of(fuzzy, "window", FUZZY_CLASS)
    known = _looked_up(df, exact, "_exact", F.lower(F.trim(raw)))
    unknown = F.col("_exact").isNull() & (F.col(raw) != "")

    def answer(values: DataFrame) -> DataFrame:
        return values.withColumn("_near", pick(F.lower(F.trim("_value")))["name"])

    joined = _per_value(known, raw, id_column, unknown, answer)
    empty = F.coalesce(F.col(raw), F.lit("")) == ""
    land_class = F.when(empty, "unspecified").otherwise(F.coalesce("_exact", "_near", F.col(raw)))
    flag = (
        F.when(empty, F.lit("empty_land_class"))
        .when(F.col("_exact").isNotNull(), F.concat(F.lit("normalized_land_class:"), raw, F.lit("->"), "_exact"))
        .when(F.col("_near").isNotNull(), F.concat(F.lit("fuzzy_normalized_land_class:"), raw, F.lit("->"), "_near"))
        .otherwise(F.concat(F.lit("unmapped_land_class:"), raw))
    )
    return joined.select(*df.columns, land_class.alias("land_class"), flag.alias("class_flag"))


def canonicalize_labels(df: DataFrame, raw: str, id_column: str) -> DataFrame:
    """Adds canonical_name and label_confidence: exact 1.0, near its ratio, unknown 0.5."""
    exact: dict[str, str] = {}
    for canonical, names in FIELD_LABELS.items():
        for s in names:
            exact.setdefault(s.lower(), canonical)
    entries = [(c, s.lower()) for c, names in FIELD_LABELS.items() for s in names]
    pick = similarity.best_of(entries, "ratio", FUZZY_LABEL)

    known = _looked_up(df, exact, "_exact", F.lower(F.trim(raw)), clean_label(F.col(raw)))

    def answer(values: DataFrame) -> DataFrame:
        return values.withColumn("_near", pick(sorted_words(clean_label(F.col("_value")))))

    joined = _per_value(known, raw, id_column, F.col("_exact").isNull(), answer)
    return joined.select(
        *df.columns,
        F.coalesce("_exact", "_near.name", F.col(raw)).alias("canonical_name"),
        F.when(F.col("_exact").isNotNull(), F.lit(1.0))
        .otherwise(F.coalesce(round_to(F.col("_near.score") / 100.0, 2), F.lit(0.5)))
        .alias("label_confidence"),
    )


def latin_names(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns(
        {"stripped_name": strip_honorifics(F.col(name)), "latin_name": transliterate(F.col(name))}
    )


def match_names(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds name_score and is_match for pairs of names across scripts.

    Equal spellings are settled where they are. Each other distinct pair is transliterated and scored once, and
    such a pair counts as equal if the Latin names are.
    """
    same = F.col(left) == F.col(right)
    latin = pairs.filter(~same).select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct().withColumns(
        {"_a": F.lower(transliterate(F.col("_l"))), "_b": F.lower(transliterate(F.col("_r")))}
    )
    different = F.col("_a") != F.col("_b")
    ratio = similarity.token_sort_ratio(F.when(different, F.col("_a")), F.when(different, F.col("_b")))
    scored = latin.withColumn("_ratio", ratio).select(
        "_l", "_r", F.when(different, F.col("_ratio")).when(F.col("_a") == F.col("_b"), F.lit(100.0)).alias("_other")
    )
    # settled pairs ask with a key of their own, which nothing answers to
    asks = F.when(same, F.concat(F.lit("\u0000"), F.xxhash64(*pairs.columns).cast("string"))).otherwise(F.col(left))
    asking = pairs.withColumns({"_same": same, "_ask": asks})
    found = asking.join(scored, (F.col("_ask") == F.col("_l")) & (F.col(right) == F.col("_r")), "left")
    return found.withColumn("_score", F.when(F.col("_same"), F.lit(100.0)).otherwise(F.col("_other"))).select(
        *pairs.columns,
        round_to(F.col("_score") / 100.0, 2).alias("name_score"),
        (F.col("_score") >= SAME_NAME).alias("is_match"),
    )
