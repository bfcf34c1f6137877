"""Column functions over strings: digits, dates, shares, names and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landq.sources.dictionaries import (
    DEVANAGARI_DIGITS,
    DOCUMENT_TYPES,
    DEFAULT_DOCUMENT_TYPE,
    GUJARATI_DIGITS,
    HONORIFICS,
    LATIN_NAMES,
    TELUGU_DIGITS,
)

# everything that is not a letter, digit, underscore or a sign of the three scripts
PUNCTUATION = r"[^\p{L}\p{N}_\x{0900}-\x{097F}\x{0A80}-\x{0AFF}\x{0C00}-\x{0C7F}]"
LABEL_PUNCTUATION = r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}\x{0A80}-\x{0AFF}\x{0C00}-\x{0C7F}]"

#: Keys that rows without a value are spread over in joins.
PARTS = 64


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value (1.005 -> 1.0, as the source data was)."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def indic_to_ascii(value: Column) -> Column:
    """Devanagari, Gujarati and Telugu digits to ASCII; null becomes the empty string."""
    digits = DEVANAGARI_DIGITS + GUJARATI_DIGITS + TELUGU_DIGITS
    return F.coalesce(F.translate(value, digits, "0123456789" * 3), F.lit(""))


def to_number(value: Column) -> Column:
    """Plain decimal or exponent notation to double, else null. Devanagari, Gujarati and Telugu digits count as digits.

    Letters a cast would take for a type suffix, a hexadecimal number, NaN or infinity are spoilt first.
    Like parse_date it reads its argument once: a derived argument is then evaluated once, and generated
    code stays small enough to be compiled.
    """
    digits = DEVANAGARI_DIGITS + GUJARATI_DIGITS + TELUGU_DIGITS
    return F.translate(value, "dDfFnNiIxXpP" + digits, "?" * 12 + "0123456789" * 3).try_cast("double")


def parse_date(value: Column) -> Column:
    """First of Y-m-d, d-m-Y, d/m/Y, Y/m/d, d.m.Y, Y.m.d that fits, else null."""
    either = r"^(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))$"
    # a text of another form is left without the mark, so nothing comes after it
    marked = F.regexp_replace(F.trim(value), either, "\u0001$1$8-$3$7-$4$5")
    return F.split_part(marked, F.lit("\u0001"), F.lit(2)).try_cast("date")


def parse_share(value: Column) -> Column:
    """Owner share as a fraction: number, a/b, or p%. Malformed shares count as 0."""
    parts = F.split(value, "/")
    fraction = F.when(
        F.size(parts) == 2, F.try_divide(to_number(F.get(parts, F.lit(0))), to_number(F.get(parts, F.lit(1))))
    )
    percent = to_number(F.trim(F.replace(value, F.lit("%"), F.lit("")))) / 100.0
    share = (
        F.when(value.contains("/"), fraction).when(value.contains("%"), percent).otherwise(to_number(value))
    )
    return F.coalesce(share, F.lit(0.0))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _part_key(value: Column, part: Column) -> Column:
    return F.when(value != "", F.concat(F.lit("="), value)).otherwise(
        F.concat(F.when(value == "", "-").otherwise("!"), part.cast("string"))
    )


def spread(value: Column, by: str) -> Column:
    """A key to join on in place of a text that many rows lack: empty and missing ones fall into PARTS keys by another column."""
    return _part_key(value, F.pmod(F.xxhash64(by), F.lit(PARTS)))


def spread_over(value: Column) -> Column:
    """All keys that ``spread`` may give for a text, for the other side of the join. Missing texts meet none, as nulls do."""
    parts = F.when(value == "", F.sequence(F.lit(0), F.lit(PARTS - 1))).when(value != "", F.array(F.lit(0)))
    return F.transform(parts, lambda part: _part_key(value, part))


def words(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda w: w != "")


def strip_honorifics(name: Column) -> Column:
    """Drop the words that are honorifics once punctuation is removed."""
    titles = F.array(*[F.lit(h) for h in dict.fromkeys(t.replace(".", "") for t in HONORIFICS)])
    kept = F.filter(
        words(name), lambda w: ~F.array_contains(titles, F.lower(F.regexp_replace(w, PUNCTUATION, "")))
    )
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def transliterate(name: Column) -> Column:
    """Honorific-free name with the known Devanagari words in Latin letters."""
    latin = F.create_map(*[F.lit(x) for pair in LATIN_NAMES.items() for x in pair])
    return F.array_join(
        F.transform(words(strip_honorifics(name)), lambda w: F.coalesce(F.try_element_at(latin, w), w)), " "
    )


def sorted_words(value: Column) -> Column:
    return F.array_join(F.array_sort(words(value)), " ")


def clean_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), LABEL_PUNCTUATION, ""))


def document_type(text: Column) -> Column:
    """struct<doc_type, confidence> by the first keyword group that occurs in the text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    result = None
    for name, confidence, terms in DOCUMENT_TYPES:
        hit = F.lit(False)
        for term in terms:
            hit = hit | lowered.contains(term)
        value = F.struct(F.lit(name).alias("doc_type"), F.lit(confidence).alias("confidence"))
        result = F.when(hit, value) if result is None else result.when(hit, value)
    name, confidence = DEFAULT_DOCUMENT_TYPE
    return result.otherwise(F.struct(F.lit(name).alias("doc_type"), F.lit(confidence).alias("confidence")))


def mask_name(name: Column) -> Column:
    """R****h K***r: first and last letter of each word stay."""

    def mask(word: Column) -> Column:
        return F.when(F.length(word) <= 2, F.concat(F.left(word, F.lit(1)), F.lit("*"))).otherwise(
            F.concat(
                F.left(word, F.lit(1)),
                F.repeat(F.lit("*"), F.length(word) - 2),
                F.right(word, F.lit(1)),
            )
        )

    return F.when(F.length(name) >= 2, F.array_join(F.transform(words(name), mask), " ")).otherwise("****")


def mask_id(value: Column) -> Column:
    """Identity, phone and tax numbers: only the last four characters stay."""
    text = F.trim(value)
    digits = F.regexp_replace(text, "[^0-9]", "")
    last = F.right(digits, F.lit(4))
    return (
        F.when(F.length(digits) == 12, F.concat(F.lit("XXXX-XXXX-"), last))
        .when(F.length(digits) == 10, F.concat(F.lit("XXXXXX"), last))
        .when(text.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), F.concat(F.lit("XXXXXX"), F.right(text, F.lit(4))))
        .when(
            F.length(text) > 4,
            F.concat(F.repeat(F.lit("*"), F.length(text) - 4), F.right(text, F.lit(4))),
        )
        .otherwise("****")
    )


# fixed values: field-name keywords of personal data
ID_KEYWORDS = ("aadhaar", "uid", "pan", "mobile", "phone")
PERSON_KEYWORDS = ("owner", "khatadar", "holder", "purchaser", "seller", "applicant", "father")
# fields that carry a person keyword without naming a person
NOT_PERSONAL = r"ownership_type|_share$|_is_minor$|_is_deceased$|^share"


def field_kind(field_name: Column) -> Column:
    """'id', 'person' or null, from the field's name."""
    name = F.lower(field_name)
    return (
        F.when(name.rlike(NOT_PERSONAL), F.lit(None))
        .when(name.rlike("|".join(ID_KEYWORDS)), F.lit("id"))
        .when(name.rlike("|".join(PERSON_KEYWORDS)), F.lit("person"))
    )


def mask_field(field_name: Column, value: Column) -> Column:
    kind = field_kind(field_name)
    return F.when(kind == "id", mask_id(value)).when(kind == "person", mask_name(value)).otherwise(value)


def finite(value: Column) -> Column:
    """NaN and infinities become 0.0; null stays null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
