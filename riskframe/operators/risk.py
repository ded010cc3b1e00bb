"""Risk scores, fallback mappings and narratives (R01-R10), request hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.dims import (LOCATION_RISK_FACTOR, SPENDING_RISK_FACTOR, V_NAMES, linear_weights)
from riskframe.functions.sqlexpr import case_map
from riskframe.functions.vecexpr import comps, vmean

# ---- R01 ---------------------------------------------------------------------------------
RISK_FLAGS = ("NULLIF(concat_ws(',', CASE WHEN transaction_amount > 1000 THEN 'high_amount' END, "
              "CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN 'unusual_hour' END, "
              "CASE WHEN p * 100 > 80 THEN 'very_high_risk' WHEN p * 100 < 20 THEN 'low_risk' END), '')")


def risk_score(df: DataFrame, p: str = "p") -> DataFrame:
    """score = 100 p, p_normal = 1 - p, HIGH if p > .5 else LOW, flag codes."""
    return df.withColumn("risk_score", F.col(p) * 100).withColumn("p_normal", 1 - F.col(p)) \
        .withColumn("risk_level", F.when(F.col(p) > 0.5, "HIGH").otherwise("LOW")) \
        .withColumn("risk_flags", F.expr(RISK_FLAGS))


# ---- R02 conservative fallback --------------------------------------------------------------
RISK_FACTOR = (f"least(1.0, {case_map('location_risk', LOCATION_RISK_FACTOR, 'CAST(0.5 AS DOUBLE)')} + "
               f"{case_map('spending_pattern', SPENDING_RISK_FACTOR, 'CAST(0.3 AS DOUBLE)')} + "
               "(CASE WHEN hour_of_day <= 5 OR hour_of_day >= 23 THEN 0.3 ELSE 0.0 END))")


# Fixed value: the merchants with a base vector of their own; all others start from zeros.
BASE_MERCHANTS = ["grocery", "restaurant", "gas", "online", "atm"]


def conservative_base(txn: DataFrame) -> DataFrame:
    """Stored per-merchant base vectors: mean V of the transactions of each merchant (a
    column of ``txn``) that has a vector of its own; one row each."""
    return txn.where(F.col("merchant_category").isin(BASE_MERCHANTS)).groupBy("merchant_category") \
        .agg(*[F.avg(v).alias(f"B{v[1:]}") for v in V_NAMES])


def conservative_fallback(df: DataFrame, base: DataFrame) -> DataFrame:
    """Risk factor r; p = min(.1 + .3r, .5); normal = max(.5, .9 - .3r); score =
    min(10 + 30r, 50); confidence .6; V = base[merchant] (zeros if none) x
    (1 + .1 min(amount/1000, 2) + .2 r).  The base table has one row per merchant
    category (bounded), so it is broadcast."""
    x = df.withColumn("risk_factor", F.expr(RISK_FACTOR)).join(F.broadcast(base), "merchant_category", "left")
    scale = 1 + F.least(F.col("transaction_amount") / 1000, F.lit(2.0)) * 0.1 + F.col("risk_factor") * 0.2
    return x.select(*df.columns, "risk_factor",
                    F.least(0.1 + F.col("risk_factor") * 0.3, F.lit(0.5)).alias("fraud_probability"),
                    F.greatest(F.lit(0.5), 0.9 - F.col("risk_factor") * 0.3).alias("normal_probability"),
                    F.least(10 + F.col("risk_factor") * 30, F.lit(50.0)).alias("risk_score"),
                    F.lit(0.6).alias("mapping_confidence"), F.lit(0).alias("prediction"), F.lit("acceptable").alias("confidence_level"),
                    *[(F.coalesce(F.col(f"B{i}"), F.lit(0.0)) * scale).alias(f"V{i}") for i in range(1, 29)])


# ---- R03 linear fallback --------------------------------------------------------------------
def linear_terms(xn: list[str]) -> list[str]:
    w = linear_weights()
    return [" + ".join(f"({w[i][j]!r} * {xn[j]})" for j in range(8)) for i in range(28)]


def linear_fallback(df: DataFrame, xn_cols: list[str]) -> DataFrame:
    """V = W (28 x 8) . normalised indicators (P11); confidence .4."""
    terms = linear_terms(xn_cols)
    return df.select("*", F.lit(0.4).alias("mapping_confidence"),
                     *[F.expr(t).alias(f"V{i + 1}") for i, t in enumerate(terms)])


# ---- R04 dataset-average fallback -----------------------------------------------------------
def average_fallback(df: DataFrame, txn: DataFrame, noise_seed: int | None = None) -> DataFrame:
    """V := dataset mean per feature (one aggregate bound once); confidence .5.  The
    reference adds 0.1 sigma noise; here optional and seeded by row id (md5) when asked."""
    st = txn.select(F.struct(*[F.struct(F.avg(v).alias("mu"), F.stddev_samp(v).alias("sd")).alias(v)
                               for v in V_NAMES])).scalar()
    x = df.withColumn("_st", st)
    cols = []
    for v in V_NAMES:
        base = F.col("_st")[v]["mu"]
        if noise_seed is not None:
            u = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(noise_seed), F.lit(v), F.col("request_id"))), 1, 8), 16, 10)
            base = base + F.col("_st")[v]["sd"] * 0.1 * (u.cast("double") / 4294967295.0 - 0.5) * 2
        cols.append(base.alias(v))
    return x.select(*df.columns, F.lit(0.5).alias("mapping_confidence"), *cols)


# ---- R05 fallback chain -----------------------------------------------------------------------
ERROR_CATEGORY = ("(CASE WHEN transaction_amount <= 0 THEN 'feature_mapping' "
                  "WHEN transaction_amount > 50000 THEN 'prediction' "
                  "WHEN NOT (hour_of_day BETWEEN 0 AND 23) THEN 'input_validation' END)")

# How severe an error of a category is; others are medium.
SEVERITY = {"prediction": "high", "model_loading": "critical", "input_validation": "low"}
# Fixed value: all error categories.
ERROR_CATEGORIES = ["input_validation", "model_loading", "feature_mapping", "prediction", "performance", "system", "network",
                    "data_corruption"]

# (name, priority, categories handled, success condition, mapping confidence)
DEFAULT_STRATEGIES = [
    ("conservative_mapping", 1, ["feature_mapping", "prediction", "model_loading"],
     "location_risk IS NOT NULL AND spending_pattern IS NOT NULL", 0.6),
    ("dataset_average", 2, ["feature_mapping"], "true", 0.5),
    ("simplified_model", 3, ["feature_mapping"], "true", 0.4),
]


def fallback_chain(df: DataFrame, strategies=None, category_expr: str = ERROR_CATEGORY) -> DataFrame:
    """For each failed request, the first strategy (by priority) that handles its error
    category and succeeds; custom strategies are extra tuples in the same list."""
    st = sorted(strategies or DEFAULT_STRATEGIES, key=lambda s: s[1])
    x = df.withColumn("error_category", F.expr(category_expr)).filter(F.col("error_category").isNotNull())
    pick = None
    conf = None
    for name, _prio, cats, ok, c in st:
        cond = F.col("error_category").isin(*cats) & F.expr(ok)
        pick = F.when(cond, F.lit(name)) if pick is None else pick.when(cond, F.lit(name))
        conf = F.when(cond, F.lit(c)) if conf is None else conf.when(cond, F.lit(c))
    return x.withColumn("strategy", pick).withColumn("recovered", F.col("strategy").isNotNull()) \
        .withColumn("mapping_confidence", conf)


# ---- R06-R10 narratives and summaries --------------------------------------------------------
NARRATIVE = ("concat_ws(' ', (CASE WHEN transaction_amount < 50 THEN 'low-value' WHEN transaction_amount > 1000 "
             "THEN 'high-value' ELSE 'moderate' END) || ' ' || replace(merchant_category, '_', ' ') || ' transaction', "
             "CASE WHEN hour_of_day >= 22 OR hour_of_day <= 6 THEN 'at night' END, "
             "CASE WHEN location_risk <> 'normal' THEN 'from a ' || replace(location_risk, '_', ' ') || ' location' END, "
             "CASE WHEN spending_pattern IN ('suspicious', 'much_higher') THEN 'with ' || replace(spending_pattern, '_', ' ') || ' spending' END, "
             "CASE WHEN input_consistency < 0.7 THEN '(inputs look inconsistent)' END)")

M = comps("M")
ABS_MAX = "greatest(" + ", ".join(f"abs({m})" for m in M) + ")"
COMPONENT_SUMMARY = {
    "total_components": "28",
    "high_magnitude_count": " + ".join(f"(CASE WHEN abs({m}) > 2 THEN 1 ELSE 0 END)" for m in M),
    "mean_absolute_value": vmean([f"abs({m})" for m in M]),
    "max_component": "(CASE " + " ".join(f"WHEN abs({m}) = {ABS_MAX} THEN 'V{i + 1}'" for i, m in enumerate(M)) + " END)",
    "positive_components": " + ".join(f"(CASE WHEN {m} > 0 THEN 1 ELSE 0 END)" for m in M),
    "negative_components": " + ".join(f"(CASE WHEN {m} < 0 THEN 1 ELSE 0 END)" for m in M),
    "near_zero_components": " + ".join(f"(CASE WHEN abs({m}) < 0.5 THEN 1 ELSE 0 END)" for m in M),
}

U = comps("U")
WIDTH = [f"(2.0 * {u})" for u in U]
INTERVAL_SUMMARY = {
    "average_interval_width": vmean(WIDTH),
    "max_interval_width": "greatest(" + ", ".join(WIDTH) + ")",
    "min_interval_width": "least(" + ", ".join(WIDTH) + ")",
    "high_uncertainty_count": " + ".join(f"(CASE WHEN {w} > 2.0 THEN 1 ELSE 0 END)" for w in WIDTH),
}
RECOMMENDATIONS = ("coalesce(NULLIF(concat_ws(',', "
                   f"CASE WHEN ({INTERVAL_SUMMARY['high_uncertainty_count']}) > 10 THEN 'high_uncertainty_use_ensemble' END, "
                   "CASE WHEN spending_pattern = 'suspicious' THEN 'verify_suspicious_spending' END, "
                   "CASE WHEN location_risk <> 'normal' THEN 'verify_location' END, "
                   "CASE WHEN merchant_category = 'grocery' AND transaction_amount > 500 THEN 'verify_grocery_amount' "
                   "WHEN merchant_category = 'atm' AND transaction_amount > 1000 THEN 'extra_atm_authentication' END), ''), "
                   "'no_specific_recommendation')")


def narrate_mapping(df: DataFrame, contrib_cols: list[str], names: list[str]) -> DataFrame:
    """Top 3 contributions by value (ties in feature order) and a note when more than
    5 mapped components have |value| > 2.  Row-local array sort, no shuffle."""
    arr = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("n"))
                    for i, (c, n) in enumerate(zip(contrib_cols, names))])
    top = F.slice(F.sort_array(arr, asc=False), 1, 3)
    note = F.when(F.expr(COMPONENT_SUMMARY["high_magnitude_count"]) > 5, "high_magnitude_components") \
        .otherwise("components_in_normal_range")
    return df.withColumn("top_factors", F.array_join(F.transform(top, lambda s: s["n"]), ",")) \
        .withColumn("mapping_note", note)


# ---- H01-H03 -------------------------------------------------------------------------------
def _json_bool(c: str) -> str:
    return f"(CASE WHEN {c} THEN 'true' ELSE 'false' END)"


INPUT_HASH_TEXT = ("'{\"amount\": ' || CAST(transaction_amount AS STRING) || ', \"day\": ' || CAST(day_of_week AS STRING) || "
                   "', \"hour\": ' || CAST(hour_of_day AS STRING) || ', \"location\": \"' || location_risk || "
                   "'\", \"merchant\": \"' || merchant_category || '\", \"spending\": \"' || spending_pattern || "
                   f"'\", \"weekend\": ' || {_json_bool('is_weekend')} || '}}'")


def input_hash(df: DataFrame) -> DataFrame:
    """sha256 of the canonical (sorted-key) JSON of the seven request fields."""
    return df.withColumn("input_hash", F.sha2(F.expr(INPUT_HASH_TEXT), 256))


def request_key_text(mapper: str) -> str:
    return ("'{\"amount\": ' || CAST(round(transaction_amount, 2) AS STRING) || ', \"day\": ' || CAST(day_of_week AS STRING) || "
            "', \"hour\": ' || CAST(hour_of_day AS STRING) || ', \"location\": \"' || location_risk || "
            f"'\", \"mapper\": \"' || {mapper} || '\", \"merchant\": \"' || merchant_category || '\", \"spending\": \"' || "
            f"spending_pattern || '\", \"weekend\": ' || {_json_bool('is_weekend')} || '}}'")


def request_key(df: DataFrame, mapper: str = "mapper_type") -> DataFrame:
    """md5 of the canonical fields (amount rounded to 2 dp) plus the mapper."""
    return df.withColumn("request_key", F.md5(F.expr(request_key_text(mapper))))
