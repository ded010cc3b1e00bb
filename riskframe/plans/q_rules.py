"""Catalog: validation rules, suggestions, merchant joins, completeness/consistency
(V01-V12, J02, J03, C01, C02, C07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.dims import MERCHANT_RANGE, MERCHANTS, merchant_dim_sql
from riskframe.operators import rules as R
from riskframe.operators import suggest
from riskframe.plans.catalog import query
from riskframe.plans.q_align import raw_requests
from riskframe.operators.align import parse_requests
from riskframe.sources import views

for _key, _rule in [("rule_amount", "amount"), ("rule_time", "time"), ("rule_merchant", "merchant"),
                    ("rule_location", "location"), ("rule_spending", "spending"),
                    ("rule_cross_field", "cross_field"), ("rule_fraud_patterns", "fraud_patterns")]:
    _e, _w = R.RULES[_rule]

    def _make(rule=_rule):
        def fn(spark, sf):
            return R.apply_rule(views.requests(spark, sf), rule).select("request_id", "errors", "warnings")
        fn.__doc__ = f"{rule} rule: error and warning codes per request"
        return fn

    query(_key, f"SELECT request_id, {_e.replace('AS STRING', 'AS VARCHAR')} AS errors, {_w} AS warnings FROM requests")(_make())


@query("input_suggestions", f"""SELECT request_id, {R.SUGGEST_AMOUNT} AS suggest_amount, {R.SUGGEST_TIME} AS suggest_time,
  {R.SUGGEST_MERCHANT} AS suggest_merchant FROM requests""")
def input_suggestions(spark, sf):
    return R.input_suggestions(views.requests(spark, sf)).select(
        "request_id", "suggest_amount", "suggest_time", "suggest_merchant")


_PEAK_SQL = f"""CASE WHEN merchant_category = 'restaurant' THEN '12,13,18,19,20'
  WHEN merchant_category = 'grocery' THEN '10,11,17,18,19'
  WHEN {R.KNOWN_M} THEN array_to_string(range(CAST(greatest(9, {R.OPEN}) AS INTEGER), CAST(least(18, {R.CLOSE}) AS INTEGER)), ',')
  ELSE '9,10,11,14,15,16,17,18' END"""


@query("time_suggestions", f"""SELECT request_id, CAST(coalesce({R.OPEN}, 0) AS INTEGER) AS open_hour,
  CAST(coalesce({R.CLOSE}, 23) AS INTEGER) AS close_hour, {_PEAK_SQL} AS peak_hours FROM requests""")
def time_suggestions(spark, sf):
    t = R.time_suggestions(views.requests(spark, sf))
    return t.select("request_id", "open_hour", "close_hour", F.array_join("peak_hours", ",").alias("peak_hours"))


@query("risk_suggestions", f"SELECT request_id, {R.RISK_LOCATION_HINT} AS location_hint, "
                           f"{R.RISK_SPENDING_HINT} AS spending_hint FROM requests")
def risk_suggestions(spark, sf):
    return R.risk_suggestions(views.requests(spark, sf)).select("request_id", "location_hint", "spending_hint")


@query("validate_requests", f"""SELECT request_id, {R.ALL_ERRORS.replace('AS STRING', 'AS VARCHAR')} AS errors,
  {R.ALL_WARNINGS.replace('AS STRING', 'AS VARCHAR')} AS warnings, {R.SUGGESTIONS} AS suggestions,
  {R.ALL_ERRORS.replace('AS STRING', 'AS VARCHAR')} IS NULL AS is_valid FROM requests""")
def validate_requests(spark, sf):
    return R.validate_requests(views.requests(spark, sf)).select(
        "request_id", "errors", "warnings", "suggestions", "is_valid")


_DIM = merchant_dim_sql()


@query("merchant_lookup", f"""SELECT r.request_id, d.merchant_category, d.merchant_ordinal, d.min_amount, d.max_amount,
  d.open_hour, d.close_hour FROM requests r JOIN ({_DIM}) d ON r.merchant_category = d.merchant_category""")
def merchant_lookup(spark, sf):
    j = suggest.merchant_lookup(views.requests(spark, sf))
    return j.select("request_id", "merchant_category", "merchant_ordinal", "min_amount", "max_amount",
                    "open_hour", "close_hour")


_SUG_SQL = f"""
WITH d AS ({_DIM}),
c AS (SELECT r.request_id, d.merchant_category AS m, d.merchant_ordinal AS o,
             abs(r.transaction_amount - (d.min_amount + d.max_amount) / 2) / d.max_amount AS fit
      FROM requests r JOIN d ON r.transaction_amount >= d.min_amount AND r.transaction_amount <= d.max_amount * 1.5),
k AS (SELECT request_id, m, row_number() OVER (PARTITION BY request_id ORDER BY fit, o) AS rk FROM c)
SELECT r.request_id, coalesce(string_agg(m, ',' ORDER BY rk), '') AS merchant_suggestions
FROM requests r LEFT JOIN k ON r.request_id = k.request_id AND k.rk <= 3 GROUP BY r.request_id"""


@query("merchant_suggestions", _SUG_SQL)
def merchant_suggestions(spark, sf):
    s = suggest.merchant_suggestions(views.requests(spark, sf))
    return s.select("request_id", F.array_join("merchant_suggestions", ",").alias("merchant_suggestions"))


def _partial_sql():
    e, w = R.RULES["amount"]
    m_ok = f"(merchant_category IS NOT NULL AND {R.KNOWN_M})"
    return f"""
WITH p AS (SELECT request_id, transaction_amount,
  CASE WHEN request_id % 11 <> 0 THEN merchant_category END AS merchant_category, hour_of_day FROM requests),
d AS ({_DIM}),
c AS (SELECT p.request_id, d.merchant_category AS m, d.merchant_ordinal AS o,
             abs(p.transaction_amount - (d.min_amount + d.max_amount) / 2) / d.max_amount AS fit
      FROM p JOIN d ON p.transaction_amount >= d.min_amount AND p.transaction_amount <= d.max_amount * 1.5),
k AS (SELECT request_id, m, row_number() OVER (PARTITION BY request_id ORDER BY fit, o) AS rk FROM c),
s AS (SELECT request_id, string_agg(m, ',' ORDER BY rk) AS ms FROM k WHERE rk <= 3 GROUP BY request_id)
SELECT p.request_id, {e} AS errors, {w} AS warnings,
  CASE WHEN p.transaction_amount > 0 THEN coalesce(s.ms, '') END AS merchant_suggestions,
  CASE WHEN {m_ok} THEN {_PEAK_SQL.replace('merchant_category', 'p.merchant_category')} END AS peak_hours,
  CASE WHEN {m_ok} THEN {R.RISK_SPENDING_HINT} END AS spending_hint,
  CASE WHEN {m_ok} THEN {R.RISK_LOCATION_HINT} END AS location_hint
FROM p LEFT JOIN s ON p.request_id = s.request_id"""


@query("validate_partial", _partial_sql())
def validate_partial(spark, sf):
    """Only the rules whose fields are present (requests parsed from JSON bodies)."""
    p = parse_requests(raw_requests(spark, sf), keep=["request_id"])
    e, w = R.RULES["amount"]
    x = p.withColumn("errors", F.expr(e)).withColumn("warnings", F.expr(w))
    x = suggest.merchant_suggestions(x)
    x = R.risk_suggestions(R.time_suggestions(x))
    m_ok = F.col("merchant_category").isNotNull() & F.expr(R.KNOWN_M)
    return x.select(
        "request_id", "errors", "warnings",
        F.when(F.col("transaction_amount") > 0, F.array_join("merchant_suggestions", ",")).alias("merchant_suggestions"),
        F.when(m_ok, F.array_join("peak_hours", ",")).alias("peak_hours"),
        F.when(m_ok, F.col("spending_hint")).alias("spending_hint"),
        F.when(m_ok, F.col("location_hint")).alias("location_hint"))


@query("input_completeness", f"SELECT request_id, {R.COMPLETENESS} AS input_completeness FROM requests")
def input_completeness(spark, sf):
    return R.completeness(views.requests(spark, sf)).select("request_id", "input_completeness")


@query("input_consistency", f"SELECT request_id, {R.CONSISTENCY} AS input_consistency FROM requests")
def input_consistency(spark, sf):
    return R.consistency(views.requests(spark, sf)).select("request_id", "input_consistency")
