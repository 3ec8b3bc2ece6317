"""Code tables: dictionaries the operators take as data.

They are small, fixed-size tables; the operators broadcast them knowingly
(their row count is fixed by this file, not by the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the original study's definitions for results
# to match.  Stated plainly, in the original order.
# ---------------------------------------------------------------------------

# chart-event item id -> measurement type
VITAL_ITEMS: dict[str, list[int]] = {
    "sbp": [220050, 220179, 225309],
    "dbp": [220051, 220180, 225310],
    "mbp": [220052, 220181, 225312],
    "heart_rate": [220045, 211],
    "respiratory_rate": [220210, 618, 615, 220339, 224690],
    "temperature": [223762, 676, 223761, 678],
    "spo2": [220277, 646],
    "rass": [228096, 228333],
    "gcs": [220739, 223900, 223901],
    "sedation_level": [228329, 228330],
    "consciousness": [226242],
}

# lab-event item id -> measurement type
LAB_ITEMS: dict[str, list[int]] = {
    "glucose": [50809, 50931, 225664],
    "creatinine": [50912],
    "bun": [51006],
    "sodium": [50983],
    "potassium": [50971],
    "chloride": [50902],
    "hematocrit": [51221],
    "hemoglobin": [51222],
    "platelet": [51265],
    "wbc": [51301],
    "lactate": [50813],
}

# diagnosis flag -> ICD code prefixes (ICD-10 then ICD-9, as listed originally)
ICD_FLAGS: dict[str, list[str]] = {
    "diabetes": ["E10", "E11", "E12", "E13", "E14", "250"],
    "hypertension": ["I10", "I11", "I12", "I13", "I15", "401", "402", "403", "404", "405"],
    "obesity": ["E66", "278.0"],
    "dyslipidemia": ["E78.0", "E78.1", "E78.2", "E78.3", "E78.4", "E78.5",
                     "272.0", "272.1", "272.2", "272.3", "272.4"],
    "thyroid_disease": ["E00", "E01", "E02", "E03", "E04", "E05", "E06", "E07",
                        "240", "241", "242", "243", "244", "245", "246"],
    "kidney_disease": ["N18", "N19", "I12", "I13", "585", "586", "403", "404"],
    "cardiovascular_disease": ["I20", "I21", "I22", "I23", "I24", "I25",
                               "410", "411", "412", "413", "414"],
    "cerebrovascular_disease": ["I60", "I61", "I62", "I63", "I64", "I65", "I66", "I67", "I68", "I69",
                                "430", "431", "432", "433", "434", "435", "436", "437", "438"],
    "smoking_icd": ["Z87.891", "F17", "Z72.0", "V15.82", "305.1", "V15.82"],
    "alcohol_icd": ["F10", "Z72.1", "K70", "305.0", "303", "571.0", "571.1", "571.2", "571.3"],
    "pregnancy": [
        "O00", "O01", "O02", "O03", "O04", "O05", "O06", "O07", "O08", "O09",
        "O10", "O11", "O12", "O13", "O14", "O15", "O16", "O20", "O21", "O22",
        "O23", "O24", "O25", "O26", "O28", "O29", "O30", "O31", "O32", "O33",
        "O34", "O35", "O36", "O40", "O41", "O42", "O43", "O44", "O45", "O46",
        "O47", "O48", "O60", "O61", "O62", "O63", "O64", "O65", "O66", "O67",
        "O68", "O69", "O70", "O71", "O72", "O73", "O74", "O75", "O80", "O81",
        "O82", "O83", "O84", "O85", "O86", "O87", "O88", "O89", "O90", "O91",
        "O92", "O94", "O95", "O96", "O97", "O98", "O99", "Z34", "Z35", "Z36",
        "Z37", "Z38", "Z39",
        "630", "631", "632", "633", "634", "635", "636", "637", "638", "639",
        "640", "641", "642", "643", "644", "645", "646", "647", "648", "649",
        "650", "651", "652", "V22", "V23", "V24", "V27", "V28",
    ],
    "sleep_disorder": ["G47", "F51", "327", "307.4"],
}

# Optional unit conversion for chart items (value * scale + offset).  The
# original averages these temperature items without converting them; the
# pipeline applies this table only when asked (``convert_units=True``).
FAHRENHEIT_ITEMS = [223761, 678]
CHART_CONVERSIONS: dict[int, tuple[float, float]] = {i: (5.0 / 9.0, -32.0 * 5.0 / 9.0) for i in FAHRENHEIT_ITEMS}

# OMR measure -> accepted result names, in order of preference
ANTHROPOMETRIC_ALIASES: dict[str, list[str]] = {
    "height": ["Height (Inches)", "Height"],
    "weight": ["Weight (Lbs)", "Weight"],
    "bmi": ["BMI (kg/m2)", "BMI"],
}
INCH_TO_CM = 2.54
LB_TO_KG = 0.453592

# OMR lifestyle flags: result-name keywords (case-insensitive substring) and
# the regex a lower-cased result value must contain.
LIFESTYLE_FLAGS: dict[str, tuple[list[str], str]] = {
    "smoking_omr": (["Smoking", "Tobacco", "Cigarette", "smoke", "smoking"],
                    "yes|current|former|quit|pack"),
    "alcohol_omr": (["Alcohol", "Drinking", "alcohol", "drinking", "drink"],
                    "yes|daily|weekly|occasional|social"),
}

# first care units that get an indicator column
MAJOR_CARE_UNITS: list[str] = [
    "Medical Intensive Care Unit (MICU)",
    "Surgical Intensive Care Unit (SICU)",
    "Cardiac Vascular Intensive Care Unit (CVICU)",
    "Coronary Care Unit (CCU)",
]

# medically impossible values: column -> (min, max); None = unbounded.
# A row is removed when a value is strictly below min or strictly above max.
RANGE_RULES: list[tuple[str, float | None, float | None]] = [
    ("age", 0, None),
    ("height_cm", 0, None),
    ("weight_kg", 0, None),
    ("bmi", 0, None),
    ("heart_rate_mean", 0.1, None),
    ("sbp_mean", 0.1, None),
    ("dbp_mean", 0, None),
    ("temperature_mean", 0, None),
    ("spo2_mean", 0, 100),
    ("respiratory_rate_mean", 0.1, None),
    ("glucose_mean", 0, None),
    ("hemoglobin_mean", 0, None),
    ("creatinine_mean", 0, None),
    ("lactate_mean", 0, None),
    ("potassium_mean", 0, None),
    ("sodium_mean", 0, None),
    ("wbc_mean", 0, None),
    ("platelet_mean", 0, None),
    ("gcs_total_mean", 3, 15),
    ("gcs_eye_mean", 1, 4),
    ("gcs_verbal_mean", 1, 5),
    ("gcs_motor_mean", 1, 6),
]

# feature-name keywords per reporting category (substring of the lower-cased name)
FEATURE_CATEGORIES: dict[str, list[str]] = {
    "vital_signs": ["hr_", "sbp_", "dbp_", "mbp_", "temp_", "resp_", "spo2_"],
    "lab_results": ["glucose_", "creatinine_", "bun_", "sodium_", "potassium_",
                    "hemoglobin_", "hematocrit_", "platelet_", "wbc_"],
    "demographics": ["anchor_age", "gender"],
    "comorbidities": ["diabetes", "hypertension", "obesity"],
    "icu_info": ["first_careunit", "los"],
    "sleep_sedation": ["sleep_", "sedation_"],
}

# statistic names of the windowed measurement aggregates, in output order
VITAL_STATS = ["mean", "max", "min", "std", "count"]
LAB_STATS = ["mean", "std", "max", "min", "count"]

# ---------------------------------------------------------------------------


def item_table(spark: SparkSession, items: dict[str, list[int | str]], key: str = "itemid",
               value: str = "item_type", key_type: T.DataType = T.LongType()) -> DataFrame:
    """Dictionary {type: [ids]} as a (key, type) table; duplicate ids keep the first type."""
    seen: dict = {}
    for typ, ids in items.items():
        for i in ids:
            seen.setdefault(i, typ)
    schema = T.StructType([T.StructField(key, key_type, False), T.StructField(value, T.StringType(), False)])
    return spark.createDataFrame(list(seen.items()), schema)


def rules_table(spark: SparkSession, rules=RANGE_RULES) -> DataFrame:
    schema = "column string, min_value double, max_value double"
    return spark.createDataFrame([(c, None if lo is None else float(lo), None if hi is None else float(hi))
                                  for c, lo, hi in rules], schema)


def keyword_table(spark: SparkSession, categories: dict[str, list[str]] = FEATURE_CATEGORIES) -> DataFrame:
    rows = [(cat, kw) for cat, kws in categories.items() for kw in kws]
    return spark.createDataFrame(rows, "category string, keyword string")
