"""The clinical pipeline on a small clinical-shaped fixture (values hand-computed)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vitalis.plans import clinical as CL
from vitalis.sources.tables import CLINICAL_SCHEMAS

T = dt.datetime
H = dt.timedelta(hours=1)
IN1, IN2, IN3 = T(2024, 1, 1, 0), T(2024, 1, 1, 12), T(2024, 1, 5, 0)

ROWS = {
    "patients": [(1, "M", 70, None), (2, "F", 50, T(2024, 1, 2, 10)), (3, "M", 60, None)],
    "admissions": [(11, None, 0), (12, T(2024, 1, 2, 9), 1), (13, None, 0), (14, None, 0)],
    "icustays": [(1, 11, 101, "Medical Intensive Care Unit (MICU)", IN1, IN1 + 50 * H, 2.0),
                 (1, 14, 104, "Coronary Care Unit (CCU)", T(2024, 2, 1), T(2024, 2, 2), 1.0),
                 (2, 12, 102, "Surgical Intensive Care Unit (SICU)", IN2, IN2 + 30 * H, 1.2),
                 (3, 13, 103, "Neuro Unit", IN3, IN3 + 40 * H, 1.6)],
    "diagnoses_icd": [(1, 11, "E119"), (1, 14, "I10"), (1, 11, "Z87891"), (2, 12, "I10"), (2, 12, "F17210"),
                      (2, 12, None)],
    "omr": [(1, dt.date(2023, 12, 1), "Height (Inches)", "70"), (1, dt.date(2023, 12, 1), "Weight (Lbs)", "154"),
            (1, dt.date(2023, 11, 1), "Weight (Lbs)", "150"), (2, dt.date(2023, 12, 2), "Smoking status", "Former smoker"),
            (3, dt.date(2023, 12, 3), "Alcohol use", "none")],
    "chartevents": [(101, 220045, IN1 + H, 80.0), (101, 211, IN1 + 2 * H, 100.0), (101, 220045, IN1 + 25 * H, 200.0),
                    (101, 999, IN1 + H, 5.0), (102, 220050, IN2 + 3 * H, 120.0), (104, 220045, T(2024, 2, 1, 1), 60.0),
                    (101, 223762, IN1 + H, 37.0), (101, 223761, IN1 + 2 * H, 98.6)],
    "labevents": [(11, 50931, IN1 + 2 * H, 110.0), (11, 50931, IN1 - H, 90.0), (None, 50931, IN1 + H, 70.0),
                  (12, 50912, IN2 + 5 * H, 1.2)],
}


@pytest.fixture(scope="module")
def tables(spark):
    base = tempfile.mkdtemp(prefix="vitalis-clinical-")
    for name, rows in ROWS.items():
        sub = "hosp" if name in CL.HOSP else "icu"
        schema = CLINICAL_SCHEMAS[name]
        data = [r + (None,) * (len(schema) - len(r)) for r in rows]
        df = spark.createDataFrame(data, schema)
        # published files hold more columns, in another order
        df = df.select(F.lit("x").alias("row_note"), *[F.col(c) for c in reversed(df.columns)], F.lit(7).alias("caregiver_id"))
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(os.path.join(base, sub, f"{name}.csv"))
    return CL.load(spark, base, "csv")


@pytest.fixture(scope="module")
def final(tables):
    return {r["subject_id"]: r.asDict() for r in CL.extract(tables).collect()}


def test_options(tables, final):
    opt = {r["subject_id"]: r.asDict() for r in CL.extract(tables, comorbidity_scope="index_admission",
                                                           convert_units=True).collect()}
    # subject 1's hypertension code belongs to a later admission
    assert final[1]["hypertension"] == 1 and opt[1]["hypertension"] == 0
    # 37.0 C and 98.6 F: averaged raw by default, both 37 C after conversion
    assert final[1]["temperature_mean"] == pytest.approx((37.0 + 98.6) / 2)
    assert opt[1]["temperature_mean"] == pytest.approx(37.0)


def test_first_stay_label_and_indicators(final):
    assert sorted(final) == [1, 2, 3]
    assert final[1]["stay_id"] == 101 and final[1]["mortality_48h"] == 0
    assert final[2]["mortality_48h"] == 1 and final[3]["mortality_48h"] == 0
    assert final[1]["gender_male"] == 1 and final[2]["gender_male"] == 0
    assert final[1]["icu_medical_intensive_care_unit"] == 1 and final[2]["icu_surgical_intensive_care_unit"] == 1
    assert final[3]["icu_coronary_care_unit"] == 0


def test_flags(final):
    assert final[1]["diabetes"] == 1 and final[1]["smoking_icd"] == 0  # dotted prefix 'Z87.891' is literal
    assert final[2]["hypertension"] == 1 and final[2]["smoking_icd"] == 1 and final[2]["smoking_omr"] == 1
    assert final[2]["smoking"] == 1 and final[1]["smoking"] == 0
    assert final[3]["alcohol_omr"] == 0 and final[3]["diabetes"] == 0


def test_measures(final):
    r = final[1]
    assert r["height_cm"] == pytest.approx(177.8)
    assert r["weight_kg"] == pytest.approx(150 * 0.453592)  # earliest weight
    assert r["bmi"] == pytest.approx(150 * 0.453592 / 1.778 ** 2)
    assert final[3]["height_cm"] is None


def test_first_day_statistics(final):
    r = final[1]
    assert (r["heart_rate_mean"], r["heart_rate_max"], r["heart_rate_min"], r["heart_rate_count"]) == (90, 100, 80, 2)
    assert r["heart_rate_std"] == pytest.approx(14.142136, abs=1e-6)
    assert r["glucose_mean"] == 110 and r["glucose_count"] == 1 and r["glucose_std"] is None
    assert final[2]["sbp_mean"] == 120 and final[2]["creatinine_mean"] == pytest.approx(1.2)
    assert final[3]["heart_rate_mean"] is None
