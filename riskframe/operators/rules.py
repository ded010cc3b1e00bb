"""Request validation rules, suggestions and confidence factors (SURVEY §2.9:
V01-V12, C01-C09).  Every rule is a SQL expression over the request columns
``transaction_amount, merchant_category, hour_of_day, day_of_week, is_weekend,
location_risk, spending_pattern`` and yields stable codes, not sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.dims import (ALWAYS_OPEN, LOCATIONS, MERCHANT_HOURS, MERCHANT_PRIOR,
                                      MERCHANT_RANGE, MERCHANTS, SCORER_RANGE, SPENDING)
from riskframe.functions.sqlexpr import case_map, codes, first_code, in_list, join_codes

A, M, H, D, W = "transaction_amount", "merchant_category", "hour_of_day", "day_of_week", "is_weekend"
L, S = "location_risk", "spending_pattern"

MIN = case_map(M, {k: v[0] for k, v in MERCHANT_RANGE.items()})
MAX = case_map(M, {k: v[1] for k, v in MERCHANT_RANGE.items()})
OPEN = case_map(M, {k: float(v[0]) for k, v in MERCHANT_HOURS.items()})
CLOSE = case_map(M, {k: float(v[1]) for k, v in MERCHANT_HOURS.items()})
SMIN = case_map(M, {k: v[0] for k, v in SCORER_RANGE.items()})
SMAX = case_map(M, {k: v[1] for k, v in SCORER_RANGE.items()})
PRIOR = case_map(M, MERCHANT_PRIOR, "CAST(0.7 AS DOUBLE)")
LATE = f"({H} >= 23 OR {H} <= 5)"
KNOWN_M, KNOWN_L, KNOWN_S = in_list(M, MERCHANTS), in_list(L, LOCATIONS), in_list(S, SPENDING)

# ---- V01-V07: (errors, warnings) per rule ---------------------------------------------
RULES: dict[str, tuple[str, str]] = {
    "amount": (
        first_code((f"{A} <= 0", "amount_non_positive"), (f"{A} > 50000", "amount_over_limit")),
        join_codes(first_code((f"{A} < {MIN} * 0.1", "amount_unusually_low"),
                              (f"{A} > {MAX} * 3", "amount_unusually_high"),
                              (f"{A} > {MAX}", "amount_above_typical")),
                   codes((f"{A} > 10000", "amount_high_value")))),
    "time": (
        codes((f"NOT ({H} BETWEEN 0 AND 23)", "hour_out_of_range"),
              (f"NOT ({D} BETWEEN 0 AND 6)", "day_out_of_range")),
        codes((f"{W} <> ({D} >= 5)", "weekend_flag_mismatch"),
              (f"NOT ({H} BETWEEN {OPEN} AND {CLOSE}) AND NOT {in_list(M, ALWAYS_OPEN)}", "outside_operating_hours"),
              (LATE, "late_night"))),
    "merchant": (
        codes((f"NOT {KNOWN_M}", "unknown_merchant")),
        first_code((f"{M} = 'other'", "other_category"), (f"{M} = 'online'", "online_risk"))),
    "location": (
        codes((f"NOT {KNOWN_L}", "unknown_location")),
        join_codes(first_code((f"{L} = 'foreign'", "foreign_location"),
                              (f"{L} = 'highly_unusual'", "highly_unusual_location")),
                   codes((f"{M} = 'atm' AND {L} = 'foreign'", "foreign_atm")))),
    "spending": (
        codes((f"NOT {KNOWN_S}", "unknown_spending")),
        join_codes(first_code((f"{S} = 'typical' AND {A} > 2000", "typical_high_amount"),
                              (f"{S} = 'suspicious' AND {A} < 50", "suspicious_low_amount"),
                              (f"{S} = 'much_higher' AND {A} < 100", "much_higher_low_amount")),
                   codes((f"{S} = 'suspicious'", "suspicious_pattern")))),
    "cross_field": (
        "CAST(NULL AS STRING)",
        join_codes(codes((f"{S} = 'typical' AND {A} > 1000", "typical_amount_inconsistent")),
                   first_code((f"{M} = 'restaurant' AND ({H} < 6 OR {H} > 23)", "restaurant_unusual_hour"),
                              (f"{M} = 'grocery' AND ({H} < 6 OR {H} > 23)", "grocery_unusual_hour")),
                   codes((f"{L} = 'foreign' AND {S} = 'typical'", "foreign_typical")))),
    "fraud_patterns": (
        "CAST(NULL AS STRING)",
        codes((f"{LATE} AND {A} >= 500.0", "late_night_high_amount"),
              (f"{L} = 'foreign' AND {A} >= 1000.0", "foreign_high_amount"),
              (f"{M} = 'atm' AND {A} >= 1000.0", "atm_unusual_amount"))),
}

# ---- suggestions (key -> code); later sources override earlier ones -------------------
SUGGEST_SPENDING = first_code((f"{L} = 'foreign' AND {S} = 'typical'", "consider_slightly_higher"),
                              (f"{S} = 'typical' AND {A} > 1000", "consider_higher_pattern"))
SUGGEST_AMOUNT = first_code((f"{A} > {MAX} * 2", "verify_amount_for_merchant"))
SUGGEST_TIME = first_code((LATE, "verify_late_night_time"))
SUGGEST_MERCHANT = first_code((f"{M} = 'other' AND {A} > 100", "choose_specific_merchant"))

SUGGESTIONS = ("NULLIF(concat_ws(',', "
               f"CASE WHEN {SUGGEST_SPENDING} IS NOT NULL THEN 'spending_pattern:' || {SUGGEST_SPENDING} END, "
               f"CASE WHEN {SUGGEST_AMOUNT} IS NOT NULL THEN 'transaction_amount:' || {SUGGEST_AMOUNT} END, "
               f"CASE WHEN {SUGGEST_TIME} IS NOT NULL THEN 'time_context:' || {SUGGEST_TIME} END, "
               f"CASE WHEN {SUGGEST_MERCHANT} IS NOT NULL THEN 'merchant_category:' || {SUGGEST_MERCHANT} END), '')")

RISK_LOCATION_HINT = first_code((f"{A} > 1000", "use_elevated_location_risk"))
RISK_SPENDING_HINT = (f"(CASE WHEN {MAX} IS NULL THEN NULL WHEN {A} <= {MAX} THEN 'typical_for_merchant' "
                      f"WHEN {A} <= {MAX} * 2 THEN 'consider_slightly_higher' "
                      f"WHEN {A} <= {MAX} * 4 THEN 'consider_much_higher' ELSE 'consider_suspicious' END)")

ALL_ERRORS = join_codes(*[e for e, _ in RULES.values()])
ALL_WARNINGS = join_codes(*[w for _, w in RULES.values()])

# ---- C01-C02, C07 -------------------------------------------------------------------
COMPLETENESS = (f"CAST(greatest(0.0, 1.0 - (CASE WHEN {A} <= 0 THEN 0.3 WHEN {A} > 10000 THEN 0.1 ELSE 0.0 END)"
                f" - (CASE WHEN NOT ({H} BETWEEN 0 AND 23) THEN 0.2 ELSE 0.0 END)"
                f" - (CASE WHEN NOT ({D} BETWEEN 0 AND 6) THEN 0.2 ELSE 0.0 END)) AS DOUBLE)")
CONSISTENCY = (f"CAST(greatest(0.0, 1.0"
               f" - (CASE WHEN {A} < {SMIN} * 0.5 OR {A} > {SMAX} * 2 THEN 0.2 ELSE 0.0 END)"
               f" - (CASE WHEN {M} = 'grocery' AND ({H} < 6 OR {H} > 23) THEN 0.1"
               f"         WHEN {M} = 'gas' AND {H} < 5 THEN 0.05"
               f"         WHEN {M} = 'restaurant' AND ({H} < 6 OR {H} > 24) THEN 0.1"
               f"         WHEN {M} = 'atm' AND {H} < 6 THEN 0.05 ELSE 0.0 END)"
               f" - (CASE WHEN {S} = 'typical' AND {A} > 1000 THEN 0.15"
               f"         WHEN {S} = 'suspicious' AND {A} < 100 THEN 0.1"
               f"         WHEN {S} = 'much_higher' AND {A} < 50 THEN 0.2 ELSE 0.0 END)"
               f" - (CASE WHEN {L} = 'foreign' AND {A} > 2000 THEN 0.1"
               f"         WHEN {L} = 'normal' AND {S} = 'suspicious' THEN 0.1 ELSE 0.0 END)) AS DOUBLE)")


def confidence_level(score: str) -> str:
    return (f"(CASE WHEN {score} >= 0.9 THEN 'Excellent' WHEN {score} >= 0.8 THEN 'Good' "
            f"WHEN {score} >= 0.7 THEN 'Acceptable' WHEN {score} >= 0.6 THEN 'Poor' ELSE 'Unacceptable' END)")


def apply_rule(df: DataFrame, rule: str) -> DataFrame:
    """Add ``errors`` and ``warnings`` code lists of one rule."""
    e, w = RULES[rule]
    return df.withColumn("errors", F.expr(e)).withColumn("warnings", F.expr(w))


def validate_requests(df: DataFrame) -> DataFrame:
    """All rules -> errors, warnings, suggestions (key:code, later wins), is_valid."""
    return df.withColumn("errors", F.expr(ALL_ERRORS)).withColumn("warnings", F.expr(ALL_WARNINGS)) \
        .withColumn("suggestions", F.expr(SUGGESTIONS)).withColumn("is_valid", F.col("errors").isNull())


def input_suggestions(df: DataFrame) -> DataFrame:
    """Suggestions of the input itself (amount, time, merchant)."""
    return df.withColumn("suggest_amount", F.expr(SUGGEST_AMOUNT)) \
        .withColumn("suggest_time", F.expr(SUGGEST_TIME)).withColumn("suggest_merchant", F.expr(SUGGEST_MERCHANT))


def risk_suggestions(df: DataFrame) -> DataFrame:
    """Location hint for amount > 1000; spending hint by amount vs merchant maximum."""
    return df.withColumn("location_hint", F.expr(RISK_LOCATION_HINT)) \
        .withColumn("spending_hint", F.expr(RISK_SPENDING_HINT))


def time_suggestions(df: DataFrame) -> DataFrame:
    """Opening hours and peak hours of the request's merchant (restaurant and grocery
    have fixed lists, else hours max(9, open) .. min(18, close) - 1)."""
    peak = (F.when(F.col(M) == "restaurant", F.array(*[F.lit(x) for x in (12, 13, 18, 19, 20)]))
            .when(F.col(M) == "grocery", F.array(*[F.lit(x) for x in (10, 11, 17, 18, 19)])))
    op, cl = F.expr(OPEN).cast("int"), F.expr(CLOSE).cast("int")
    lo, hi = F.greatest(F.lit(9), op), F.least(F.lit(18), cl) - 1
    rng = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    default = F.array(*[F.lit(x) for x in (9, 10, 11, 14, 15, 16, 17, 18)])
    known = F.expr(KNOWN_M)
    return df.withColumn("open_hour", F.when(known, op).otherwise(F.lit(0))) \
        .withColumn("close_hour", F.when(known, cl).otherwise(F.lit(23))) \
        .withColumn("peak_hours", F.when(known, F.coalesce(peak, rng)).otherwise(default))


def completeness(df: DataFrame) -> DataFrame:
    return df.withColumn("input_completeness", F.expr(COMPLETENESS))


def consistency(df: DataFrame) -> DataFrame:
    return df.withColumn("input_consistency", F.expr(CONSISTENCY))
