"""Explicit schemas of the record documents and of the tables derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BREAKDOWN = _struct(ocr=D, agreement=D, damage_penalty=D, format=D, consistency=D, final=D)

FIELD_ITEM = _struct(
    value=S,
    raw_text=S,
    confidence=D,
    bbox=T.ArrayType(D),
    source_engine=S,
    flags=T.ArrayType(S),
    confidence_breakdown=BREAKDOWN,
)

OWNER = _struct(
    name=FIELD_ITEM,
    father_or_husband_name=FIELD_ITEM,
    share=FIELD_ITEM,
    is_minor=FIELD_ITEM,
    is_deceased=FIELD_ITEM,
)

MUTATION = _struct(
    mutation_no=FIELD_ITEM,
    mutation_date=FIELD_ITEM,
    registration_date=FIELD_ITEM,
    mutation_type=FIELD_ITEM,
    from_party=FIELD_ITEM,
    to_party=FIELD_ITEM,
    transferred_area=FIELD_ITEM,
    order_ref=FIELD_ITEM,
    status=FIELD_ITEM,
)

REGISTRATION = _struct(
    reg_no=FIELD_ITEM, reg_date=FIELD_ITEM, sub_registrar_office=FIELD_ITEM, stamp_duty_paid=FIELD_ITEM
)

PLOT_AREA = _struct(value=FIELD_ITEM, unit=FIELD_ITEM, area_sqm=FIELD_ITEM, area_hectares=FIELD_ITEM)

EXTRACTION = _struct(
    document_type=FIELD_ITEM,
    state=FIELD_ITEM,
    district=FIELD_ITEM,
    tehsil=FIELD_ITEM,
    village=FIELD_ITEM,
    survey_no=FIELD_ITEM,
    khasra_no=FIELD_ITEM,
    khata_no=FIELD_ITEM,
    sub_division=FIELD_ITEM,
    ulpin=FIELD_ITEM,
    plot_area=PLOT_AREA,
    land_classification=FIELD_ITEM,
    ownership_type=FIELD_ITEM,
    landowners=T.ArrayType(OWNER),
    mutation_entries=T.ArrayType(MUTATION),
    registration=REGISTRATION,
    encumbrances_or_loans=FIELD_ITEM,
    remarks_or_annotations=FIELD_ITEM,
    na_conversion_order_ref=FIELD_ITEM,
    restricted_tenure_permission_ref=FIELD_ITEM,
)

RECORD = _struct(image_hash=S, extraction=EXTRACTION, agreements=T.MapType(S, D))

POINT = _struct(x=D, y=D)

PARCEL_FEATURES = _struct(
    features=T.ArrayType(
        _struct(
            properties=_struct(
                ulpin=S,
                survey_no=S,
                village=S,
                tehsil=S,
                district=S,
                state=S,
                area_sqm=D,
                recorded_text_area_sqm=D,
                area_mismatch_pct=D,
                neighbours=T.ArrayType(S),
            ),
            geometry=_struct(type=S, coordinates=T.ArrayType(T.ArrayType(T.ArrayType(D)))),
        )
    )
)

# columns of every rule's output
RESULT_COLUMNS = ("document_id", "rule_id", "rule_name", "severity", "status", "message", "evidence", "disclaimer")
