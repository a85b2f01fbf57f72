"""First-match-wins triage rules as one CASE expression each, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import days_since, is_true
from episcope.operators.clean import starts_with_any
from episcope.operators.tabulate import counts

# Isolation windows in days since arrival, and the fever threshold in Fahrenheit.
COVID_DAYS, FLU_DAYS, SYMPTOM_DAYS, FEVER = 11, 8, 5, 100.0


def _facts(as_of: str | Column, fever: float, arrival: str) -> tuple[Column, Column, Column]:
    days = days_since(arrival, as_of)
    hot = is_true(F.col("temp") >= fever)
    symptoms = is_true(F.lower(F.trim(F.col("symptoms"))) != "none")
    return days, hot, symptoms


def _positive(status: str) -> Column:
    return is_true(F.col(f"{status}_status") == "positive")


def triage_decision(as_of: str | Column, fever: float = FEVER, arrival: str = "arrival_date") -> Column:
    """Struct of decision and reason. A positive COVID or flu test always decides, even past its window."""
    days, hot, symptoms = _facts(as_of, fever, arrival)

    def verdict(decision: str, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("triage_decision"), F.lit(reason).alias("triage_reason"))

    def window(name: str, limit: int) -> Column:
        return (F.when(days <= limit, verdict(f"Quarantine ({name} - Active)", name))
                .when(hot, verdict(f"Quarantine ({name} - Fever Post Isolation)", name))
                .otherwise(verdict(f"Clear ({name} - Past Window)", name)))

    return (F.when(_positive("lice"), verdict("Isolate (Lice)", "Lice"))
            .when(_positive("varicella"), verdict("Isolate (Varicella)", "Varicella"))
            .when(_positive("covid"), window("COVID", COVID_DAYS))
            .when(_positive("flu"), window("Flu", FLU_DAYS))
            .when(hot & symptoms & (days <= SYMPTOM_DAYS), verdict("Quarantine (Symptomatic)", "Symptom-Based"))
            .otherwise(verdict("Clear", "None")))


def triage(df: DataFrame, as_of: str | Column, fever: float = FEVER, arrival: str = "arrival_date") -> DataFrame:
    return df.withColumn("__t", triage_decision(as_of, fever, arrival)).select("*", "__t.*").drop("__t")


def triage_reason(as_of: str | Column, fever: float = FEVER, arrival: str = "arrival_date") -> Column:
    """Label for modelling. Unlike the decision, a positive test past its window without fever falls through to the
    later rules."""
    days, hot, symptoms = _facts(as_of, fever, arrival)
    return (F.when(_positive("lice"), "Lice")
            .when(_positive("varicella"), "Varicella")
            .when(_positive("covid") & ((days <= COVID_DAYS) | hot), "COVID")
            .when(_positive("flu") & ((days <= FLU_DAYS) | hot), "Flu")
            .when(hot & symptoms & (days <= SYMPTOM_DAYS), "Symptom-Based")
            .otherwise("None"))


def triage_label(df: DataFrame, as_of: str | Column, fever: float = FEVER, arrival: str = "arrival_date",
                 out: str = "triage_reason") -> DataFrame:
    return df.withColumn(out, triage_reason(as_of, fever, arrival))


def held_counts(df: DataFrame, prefixes: Sequence[str] = ("Isolate", "Quarantine")) -> DataFrame:
    """Isolated or quarantined cases by reason, largest first."""
    return counts(df, ["triage_reason"], starts_with_any("triage_decision", prefixes), out="case_count")


def threshold_sensitivity(df: DataFrame, as_of: str | Column, thresholds: Mapping[str, float],
                          arrival: str = "arrival_date", digits: int = 3) -> DataFrame:
    """Share of each label under each fever threshold, one column per threshold.

    All labels of a row are derived side by side and counted once by their combination, so rows are neither copied
    per threshold nor read twice. Shares are taken before the ``None`` label is dropped.
    """
    labelled = df.select(*[triage_reason(as_of, t, arrival).alias(name) for name, t in thresholds.items()])
    combos = labelled.groupBy(*thresholds).agg(F.count(F.lit(1)).alias("n"))
    long = combos.unpivot(["n"], list(thresholds), "threshold", "triage_reason")
    total = combos.select(F.sum("n")).scalar()
    shares = long.groupBy("triage_reason").agg(*[
        F.sum(F.when(F.col("threshold") == name, F.col("n")).otherwise(0)).alias(name) for name in thresholds])
    return shares.where(F.col("triage_reason") != "None").select(
        "triage_reason", *[F.round(F.col(n) / total, digits).alias(n) for n in thresholds])
