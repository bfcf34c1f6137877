"""Regional dictionaries, administrative directory, roles and rule book.

The tables below are fixed values: results depend on them word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values: digits
DEVANAGARI_DIGITS = "०१२३४५६७८९"
GUJARATI_DIGITS = "૦૧૨૩૪૫૬૭૮૯"
TELUGU_DIGITS = "౦౧౨౩౪౫౬౭౮౯"

# ---------------------------------------------------------------- fixed values: area units
# unit -> (square metres per unit, spellings)
STANDARD_UNITS = {
    "sqm": (1.0, ["sqm", "sq m", "sq.m", "square meter", "square metre", "वर्ग मीटर", "चौ मीटर"]),
    "hectare": (10000.0, ["hectare", "ha", "hec", "हेक्टर", "हेक्टेयर", "హెక్టారు"]),
    "acre": (4046.8564224, ["acre", "ac", "एकड़", "एकर", "ఎకరం"]),
    "guntha": (101.17141056, ["guntha", "gunta", "गुंठा", "गुंठे", "గుంట"]),
    "are": (100.0, ["are", "aar", "आर", "आर."]),
    "cent": (40.468564, ["cent", "cents", "सेंट", "సెంట్"]),
}

# unit -> (smallest and largest square metres per unit, spellings)
STATE_UNITS = {
    "bigha": (800.0, 2529.285264, ["bigha", "beeghe", "बीघा", "बिघा"]),
    "biswa": (50.58, 126.46, ["biswa", "बिस्वा", "बिस्वे"]),
    "katha": (66.89, 267.56, ["katha", "kattha", "कट्ठा", "कठ्ठा"]),
    "kanal": (505.857, 505.857, ["kanal", "कनाल"]),
    "marla": (25.293, 25.293, ["marla", "मरला"]),
}

STATE_UNIT_FACTORS = {
    "bigha": {
        "uttar pradesh": 2529.285264,
        "up": 2529.285264,
        "uttarakhand": 2529.285264,
        "bihar": 2529.285264,
        "rajasthan": 1618.74,
        "madhya pradesh": 1335.46,
        "mp": 1335.46,
        "west bengal": 1333.33,
        "punjab": 1011.714,
        "haryana": 1011.714,
        "himachal pradesh": 800.0,
        "hp": 800.0,
        "assam": 1337.8,
    },
    "biswa": {
        "uttar pradesh": 126.464,
        "up": 126.464,
        "rajasthan": 80.937,
        "punjab": 50.5857,
        "haryana": 50.5857,
    },
    "katha": {"bihar": 126.464, "west bengal": 66.89, "assam": 267.56},
    "kanal": {
        "punjab": 505.857,
        "haryana": 505.857,
        "himachal pradesh": 505.857,
        "jammu and kashmir": 505.857,
    },
    "marla": {"punjab": 25.29285, "haryana": 25.29285, "himachal pradesh": 25.29285},
}

# ---------------------------------------------------------------- fixed values: land classes (in order)
LAND_CLASSES = {
    "irrigated": [
        "irrigated", "chahi", "nahri", "bagayat", "bagayat_irrigated",
        "सिंचित", "बागायत", "नहरी", "चाही", "सिंचाई योग्य", "पियत",
        "వరి పండే భూమి", "నీటిపారుదల భూమి",
    ],
    "unirrigated_dry": [
        "dry", "unirrigated", "rainfed", "barani", "jirayat", "asinchit",
        "जिरायत", "असिंचित", "कोरडवाहू", "बारानी", "शुष्क",
        "మెట్ట భూమి", "వర్షాధార భూమి",
    ],
    "barren_waste": [
        "barren", "waste", "uncultivable", "usar", "banjar", "pad zameen",
        "बंजर", "पड जमीन", "ऊसर", "अनुपजाऊ", "खार जमीन",
        "బంజరు భూమి", "బీడు భూమి",
    ],
    "habitation_abadi": [
        "abadi", "gawthan", "habitation", "residential", "village site",
        "आबादी", "गावठाण", "वस्ती", "आवासीय", "गाँव आबादी",
        "గ్రామ కంఠం", "నివాస స్థలము",
    ],
    "forest_government": [
        "forest", "reserved forest", "jungle", "vanya", "sarkari",
        "जंगल", "वन", "वन्य", "सरकारी वन", "संरक्षित वन",
        "అటవీ భూమి",
    ],
    "non_agricultural": [
        "na", "non agricultural", "commercial", "industrial", "converted",
        "अकृषक", "अकृषिक", "बिगरशेती", "एनए", "व्यावसायिक", "औद्योगिक",
        "వ్యవసాయేతర భూమి",
    ],
}

# ---------------------------------------------------------------- fixed values: field labels (in order)
FIELD_LABELS = {
    "survey_or_khasra_no": [
        "survey no", "survey_no", "survey number", "sy.no", "sy no", "syno",
        "khasra", "khasra no", "khasra number", "gata", "gata no", "gata sankhya",
        "सर्वे नंबर", "सर्वे क्र", "सर्वे क्रमांक", "गट नंबर", "गट क्रमांक",
        "खसरा", "खसरा संख्या", "खसरा नं", "गाटा", "गाटा संख्या",
        "సర్వే నంబర్", "రచ్చబండ సర్వే నం",
    ],
    "khata_no": [
        "khata", "khata no", "khata number", "khatoni", "khatauni", "khatauni no",
        "खाता", "खाता संख्या", "खाते क्रमांक", "खाता नं", "खातेदार क्रमांक",
        "खाता विवरण", "खातादार", "ఖాతా నంబరు",
    ],
    "sub_division": [
        "sub division", "sub_division", "hissa", "hissa no", "pot hissa",
        "पोटहिस्सा", "हिस्सा", "हिस्सा क्रमांक", "उप विभाजन", "उपविभाग",
        "హిస్సా",
    ],
    "record_type": [
        "7/12 utara", "7 12", "7/12", "satbara", "saat baara",
        "khatauni", "khatoni", "jamabandi",
        "patta", "chitta", "adangal", "pahani", "rtc", "sale deed", "mutation extract",
    ],
    "owner_name": [
        "owner", "owner name", "landowner", "pattedar", "khatadar", "holder",
        "खातेदाराचे नाव", "खातेदार का नाम", "जमीनदाराचे नाव", "मालिक", "पट्टेदार", "पट्टादार",
        "ఖాతాదారు పేరు", "భూయజమాని పేరు",
    ],
    "father_or_husband_name": [
        "father name", "husband name", "father or husband", "parent name",
        "वडिलांचे नाव", "पतीचे नाव", "पिता का नाम", "पति का नाम", "पिता/पति",
        "తండ్రి పేరు", "భర్త పేరు",
    ],
    "plot_area": [
        "area", "plot area", "holding area", "total area", "extent", "rakba",
        "क्षेत्रफळ", "रकबा", "एकूण क्षेत्र", "विस्तीर्ण", "क्षेत्र", "విస్తీర్ణము",
    ],
    "village": ["village", "mauza", "gram", "gaon", "gao", "गाव", "ग्राम", "मौजा", "गाँव", "గ్రామము"],
    "tehsil": ["tehsil", "taluk", "taluka", "mandal", "तालुका", "तहसील", "मंडल", "తాలూకా", "మండలము"],
    "district": ["district", "jila", "zilla", "जिल्हा", "ज़िला", "जिला", "జిల్లా"],
    "state": ["state", "rajya", "राज्य", "రాష్ట్రము"],
    "land_classification": [
        "land class", "land classification", "nature of land", "land type",
        "जमिनीचा प्रकार", "भूमि प्रकार", "धारणा प्रकार", "धरम", "భూమి వర్గీకరణ",
    ],
    "ulpin": [
        "ulpin", "bhu aadhaar", "unique land parcel identification number",
        "भू आधार", "यूएलपीआईएन",
    ],
}

# ---------------------------------------------------------------- fixed values: names
HONORIFICS = [
    "shri", "shree", "sri", "smt", "shrimati", "kumari", "km", "late", "dr", "mr", "mrs", "ms",
    "श्री", "श्रीमती", "सुश्री", "कु.", "कुमारी", "स्व.", "स्वर्गवासी", "स्वर्गीय", "चि.", "मे.", "डॉ.",
    "శ్రీ", "శ్రీమతి", "కుమారి",
]

LATIN_NAMES = {
    "रमेश": "Ramesh",
    "पाटील": "Patil",
    "सुरेश": "Suresh",
    "जोशी": "Joshi",
    "राजेश": "Rajesh",
    "शर्मा": "Sharma",
    "राम": "Ram",
    "कुमार": "Kumar",
    "वर्मा": "Verma",
    "अशोक": "Ashok",
    "यादव": "Yadav",
    "संजय": "Sanjay",
    "सिंह": "Singh",
    "किरण": "Kiran",
    "देशमुख": "Deshmukh",
    "विष्णु": "Vishnu",
    "पवार": "Pawar",
    "गणेश": "Ganesh",
    "कुलकर्णी": "Kulkarni",
    "अमित": "Amit",
    "गुप्ता": "Gupta",
    "प्रमोद": "Pramod",
    "शिंदे": "Shinde",
    "बाबूराव": "Baburao",
    "चव्हाण": "Chavan",
    "दत्तात्रेय": "Dattatraya",
    "गायकवाड": "Gaikwad",
    "ज्ञानेश्वर": "Dnyaneshwar",
    "मोरे": "More",
    "नारायण": "Narayan",
    "जाधव": "Jadhav",
}

# ---------------------------------------------------------------- fixed values: document types (in order)
DOCUMENT_TYPES = [
    ("khatauni_7_12", 0.94, ["7/12", "satbara", "गाव नमुना ७", "अधिकार अभिलेख", "खतौनी", "khatauni", "form 45", "ror"]),
    ("mutation_register", 0.92, ["गाव नमुना ६", "फेरफार", "नामांतरण", "mutation register", "mutation no", "intkal"]),
    ("sale_deed", 0.93, ["बैनामा", "खरेदीखत", "sale deed", "conveyance", "sub-registrar", "stamp duty"]),
    ("cadastre_map", 0.95, ["नकाशा", "cadastral map", "village map", "bhu naksha"]),
]
DEFAULT_DOCUMENT_TYPE = ("khatauni_7_12", 0.70)

# ---------------------------------------------------------------- fixed values: administrative directory
ADMIN_DIRECTORY = {
    "maharashtra": {
        "pune": {
            "haveli": ["Wagholi", "Kharadi", "Hadapsar", "Loni Kalbhor", "Manjri", "Undri"],
            "mulshi": ["Pirangut", "Paud", "Hinjawadi", "Maan", "Lavale"],
            "khed": ["Chakan", "Alandi", "Rajgurunagar", "Mahalunge"],
            "baramati": ["Malegaon", "Baramati Rural", "Supa", "Karkamb"],
        },
        "satara": {
            "karad": ["Ond", "Saidapur", "Kale", "Umbraj"],
            "wai": ["Bhuinj", "Pachwad", "Shirwal"],
        },
        "nagpur": {"nagpur rural": ["Besur", "Wadi", "Kamptee", "Hingna"]},
    },
    "uttar pradesh": {
        "lucknow": {
            "bakshi ka talab": ["Bargadi", "Asthi", "Kathwara", "Mandiaon"],
            "sarojini nagar": ["Amausi", "Banthra", "Natkur", "Gauri"],
            "malihabad": ["Saspan", "Kakori", "Rahimabad"],
        },
        "varanasi": {
            "pindra": ["Sindhora", "Phoolpur", "Babepur"],
            "sadar": ["Shivpur", "Kashi Rural", "Lohta"],
        },
    },
    "bihar": {
        "patna": {
            "danapur": ["Khagaul", "Digha", "Maner"],
            "phulwari sharif": ["Sampatchak", "Janipur", "Alawalpur"],
        }
    },
}

# ---------------------------------------------------------------- fixed values: roles
ROLE_ALIASES = {
    "officer": "supervisor",
    "reviewer": "verifier",
    "officer_1": "supervisor",
    "reviewer_1": "verifier",
}

ROLE_PERMISSIONS = {
    "admin": [
        "DOCUMENT_READ", "DOCUMENT_UPLOAD", "DOCUMENT_DELETE", "REVIEW_TASK_VIEW", "REVIEW_TASK_MAKER",
        "REVIEW_TASK_CHECKER", "VALIDATION_RULES_MANAGE", "AUDIT_LOG_READ", "AUDIT_CHAIN_VERIFY",
        "ANALYTICS_VIEW", "API_INTEGRATION_ACCESS", "VIEW_PII", "EXPORT_FINETUNING",
    ],
    "supervisor": [
        "DOCUMENT_READ", "DOCUMENT_UPLOAD", "REVIEW_TASK_VIEW", "REVIEW_TASK_MAKER", "REVIEW_TASK_CHECKER",
        "AUDIT_LOG_READ", "AUDIT_CHAIN_VERIFY", "ANALYTICS_VIEW", "API_INTEGRATION_ACCESS", "VIEW_PII",
        "EXPORT_FINETUNING",
    ],
    "verifier": ["DOCUMENT_READ", "REVIEW_TASK_VIEW", "REVIEW_TASK_MAKER", "ANALYTICS_VIEW", "VIEW_PII"],
    "operator": ["DOCUMENT_READ", "DOCUMENT_UPLOAD", "REVIEW_TASK_VIEW", "ANALYTICS_VIEW"],
    "auditor": ["DOCUMENT_READ", "AUDIT_LOG_READ", "AUDIT_CHAIN_VERIFY", "ANALYTICS_VIEW", "VIEW_PII"],
    "readonly_api": ["DOCUMENT_READ", "API_INTEGRATION_ACCESS"],
}

# ---------------------------------------------------------------- fixed values: tamper points per flag type
TAMPER_POINTS = {
    "ela_compression_discrepancy": 30,
    "texture_noise_inconsistency": 35,
    "digit_overwriting_detected": 40,
    "copy_move_cloning_hint": 25,
    "multiple_ink_strokes_detected": 20,
    "editing_software_metadata_hint": 30,
    "text_logic_duplicate_registration": 35,
    "text_logic_anachronistic_dates": 25,
}

# ---------------------------------------------------------------- fixed values: notices
LEGAL_DISCLAIMER = "advisory, not legal advice"
FORENSIC_DISCLAIMER = "indicator for human review, not proof"


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation, so that its size is known to the optimizer."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({', '.join(columns)})")


def unit_synonyms(spark: SparkSession) -> DataFrame:
    """spelling -> unit with its fixed factor, or its range when it varies by state."""
    rows = []
    for unit, (factor, names) in STANDARD_UNITS.items():
        rows += [(name.lower(), unit, factor, None, None) for name in dict.fromkeys([unit, *names])]
    for unit, (low, high, names) in STATE_UNITS.items():
        rows += [(name.lower(), unit, None, low, high) for name in dict.fromkeys([unit, *names])]
    return inline_table(spark, ["spelling", "unit", "sqm_factor", "min_sqm", "max_sqm"], rows)


def state_factors(spark: SparkSession) -> DataFrame:
    rows = [(u, s, f) for u, states in STATE_UNIT_FACTORS.items() for s, f in states.items()]
    return inline_table(spark, ["unit", "state_key", "state_factor"], rows)


def land_class_synonyms(spark: SparkSession) -> DataFrame:
    rows = [(c, s.lower(), i) for i, (c, names) in enumerate(LAND_CLASSES.items()) for s in names]
    return inline_table(spark, ["land_class", "synonym", "ord"], rows)


def field_label_synonyms(spark: SparkSession) -> DataFrame:
    rows, ord_ = [], 0
    for canonical, names in FIELD_LABELS.items():
        for name in names:
            rows.append((canonical, name.lower(), ord_))
            ord_ += 1
    return inline_table(spark, ["canonical", "synonym", "ord"], rows)


def admin_hierarchy(spark: SparkSession) -> DataFrame:
    rows = [
        (state, district, tehsil, village.lower())
        for state, districts in ADMIN_DIRECTORY.items()
        for district, tehsils in districts.items()
        for tehsil, villages in tehsils.items()
        for village in villages
    ]
    return inline_table(spark, ["state", "district", "tehsil", "village"], rows)


def role_aliases(spark: SparkSession) -> DataFrame:
    rows = list(ROLE_ALIASES.items()) + [(r, r) for r in ROLE_PERMISSIONS]
    return inline_table(spark, ["alias", "role"], rows)


def role_permissions(spark: SparkSession) -> DataFrame:
    rows = [(role, p) for role, names in ROLE_PERMISSIONS.items() for p in names]
    return inline_table(spark, ["role", "permission"], rows)


def has_permission(role: str, permission: str) -> bool:
    """Role check for choosing the masked or the plain projection while the plan is built."""
    key = role.lower()
    return permission in ROLE_PERMISSIONS.get(ROLE_ALIASES.get(key, key), [])
