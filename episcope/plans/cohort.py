"""Patient labels from codes and prescriptions, and how often notes mention a symptom by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.operators.filters import mentions
from episcope.operators.joins import enrich, exists_labels
from episcope.operators.tabulate import drop_null_keys

# Diagnosis codes that count as diabetes, and the words read as a gut symptom.
DIABETES_CODES = ("E11.9", "R73.03")
GI_PATTERN = "nausea|gastrointestinal|gi intolerance"


def patient_labels(diagnoses: DataFrame, prescriptions: DataFrame, key: str = "patient_id",
                   code: str = "icd_code", codes=DIABETES_CODES) -> DataFrame:
    """``has_diabetes`` from any listed code, ``glp1_exposed`` from any prescription; one row per patient seen."""
    return exists_labels({"has_diabetes": (diagnoses, F.col(code).isin(*codes)),
                          "glp1_exposed": (prescriptions, F.lit(True))}, key)


def mention_rates(notes: DataFrame, labels: DataFrame, key: str, text: str, pattern: str,
                  by: str | Column) -> DataFrame:
    """Share of notes that mention the pattern, by patient label. Notes without a label are not reported."""
    flagged = mentions(notes.select(key, text), text, pattern, "mention")
    label = F.col(by) if isinstance(by, str) else by
    joined = enrich(flagged, labels, key).withColumn("label", label)
    return drop_null_keys(joined, ["label"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_if("mention").alias("n_mentions"),
        F.avg(F.col("mention").cast("int")).alias("mention_rate"))
