"""Catalog: bounds repair (B01-B03), risk scores and fallbacks (R01-R10), hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, MERCHANTS, V_NAMES, sql_list
from riskframe.functions.vecexpr import comps, vmean
from riskframe.operators import bounds as B
from riskframe.operators import risk as K
from riskframe.operators import rules as R
from riskframe.operators.align import input_enrichment, INTERPRETABLE
from riskframe.plans.catalog import query
from riskframe.sources import views

_Q = lambda c: f'"{c}"' if c == "Time" else c


def assembled(spark, sf):
    """Assembled request vectors: context Time, mapped V (= M), Amount; plus mean uncertainty."""
    m = views.mapping_rows(spark, sf)
    return m.select("request_id",
                    (F.col("day_of_week") * 86400 + F.col("hour_of_day") * 3600 + 2619).cast("double").alias("Time"),
                    *[F.col(f"M{i}").alias(f"V{i}") for i in range(1, 29)],
                    F.col("transaction_amount").alias("Amount"),
                    F.expr(vmean(comps("U"))).alias("unc_mean"))


def bounds_table(spark, sf):
    return B.feature_bounds(views.txn(spark, sf))


_ASM_SQL = ("asm AS (SELECT request_id, (day_of_week * 86400 + hour_of_day * 3600 + 2619)::DOUBLE AS \"Time\", "
            + ", ".join(f"M{i} AS V{i}" for i in range(1, 29)) + ", transaction_amount AS Amount, "
            + vmean(comps("U")) + " AS unc_mean FROM mapping_rows)")
_LONG_SQL = ("lng AS (SELECT request_id, feature, value FROM (SELECT request_id, " + ", ".join(_Q(c) for c in FEATURES)
             + " FROM asm) UNPIVOT (value FOR feature IN (" + ", ".join(_Q(c) for c in FEATURES) + ")))")
_BND_SQL = ("bnd AS (SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std FROM ("
            + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_Q(c)}::DOUBLE AS value FROM txn" for c in FEATURES)
            + ") GROUP BY feature)")


@query("bounds_violations", f"""WITH {_ASM_SQL}, {_LONG_SQL}, {_BND_SQL}
SELECT request_id, l.feature, value, CASE WHEN value < min THEN 'below' ELSE 'above' END AS side,
  CASE WHEN value < min THEN min - value ELSE value - max END AS excess
FROM lng l JOIN bnd b ON l.feature = b.feature WHERE value < min OR value > max""")
def bounds_violations(spark, sf):
    return B.bounds_violations(assembled(spark, sf), bounds_table(spark, sf), "request_id")


_CORR = ("CASE WHEN l.feature LIKE 'V%' AND abs(value - mean) > 3 * std THEN (CASE WHEN value > mean THEN mean + 3 * std "
         "ELSE mean - 3 * std END) ELSE least(greatest(value, min), max) END")


@query("bounds_correction", f"""WITH {_ASM_SQL}, {_LONG_SQL}, {_BND_SQL}
SELECT request_id, l.feature, value, round({_CORR}, 6) + 0.0 AS corrected FROM lng l JOIN bnd b ON l.feature = b.feature""")
def bounds_correction(spark, sf):
    r = B.bounds_correction(assembled(spark, sf), bounds_table(spark, sf), "request_id")
    return r.select("request_id", "feature", "value", rnd("corrected", 6).alias("corrected"))


@query("repair_vectors", f"""WITH {_ASM_SQL}, {_LONG_SQL}, {_BND_SQL},
v AS (SELECT request_id, sum(CASE WHEN value < min OR value > max THEN 1 ELSE 0 END) AS nv,
  sum(CASE WHEN ({_CORR}) <> value THEN 1 ELSE 0 END) AS nc FROM lng l JOIN bnd b ON l.feature = b.feature GROUP BY request_id)
SELECT a.request_id, CAST(nv AS INTEGER) AS n_violations, nv = 0 AS is_valid,
  CAST(CASE WHEN nv = 0 THEN 0 ELSE nc END AS INTEGER) AS n_changed,
  round((1.0::DOUBLE + (1.0::DOUBLE - 0.8::DOUBLE) + 0.9::DOUBLE + (1.0::DOUBLE - unc_mean)) / 4.0, 9) AS quality_confidence
FROM asm a JOIN v ON a.request_id = v.request_id""")
def repair_vectors(spark, sf):
    r = B.repair_vectors(assembled(spark, sf), bounds_table(spark, sf), "request_id", "unc_mean")
    return r.select("request_id", "n_violations", "is_valid", "n_changed",
                    rnd("quality_confidence", 9).alias("quality_confidence"))


def _risk_input(spark, sf):
    return views.request_scores(spark, sf)


@query("risk_score", f"""SELECT request_id, p * 100 AS risk_score, 1 - p AS p_normal,
  CASE WHEN p > 0.5 THEN 'HIGH' ELSE 'LOW' END AS risk_level, {K.RISK_FLAGS} AS risk_flags
FROM requests r JOIN scored s ON r.request_id = s.event_id""")
def risk_score(spark, sf):
    return K.risk_score(_risk_input(spark, sf)).select("request_id", "risk_score", "p_normal", "risk_level", "risk_flags")


_BASE_SQL = ("base AS (SELECT merchant_category, "
             + ", ".join(f"avg({v}) AS B{v[1:]}" for v in V_NAMES)
             + " FROM mapping_rows WHERE merchant_category IN ('grocery', 'restaurant', 'gas', 'online', 'atm') GROUP BY 1)")
# The oracle's own text of the risk factor: location and spending add their table values, unknown ones 0.5 and 0.3.
_RISK_SQL = """least(1.0::DOUBLE, CASE r.location_risk WHEN 'normal' THEN 0.0::DOUBLE WHEN 'slightly_unusual' THEN 0.3 WHEN 'highly_unusual' THEN 0.6
    WHEN 'foreign' THEN 0.8 ELSE 0.5 END + CASE r.spending_pattern WHEN 'typical' THEN 0.0::DOUBLE WHEN 'slightly_higher' THEN 0.2
    WHEN 'much_higher' THEN 0.5 WHEN 'suspicious' THEN 0.9 ELSE 0.3 END + CASE WHEN hour_of_day >= 23 OR hour_of_day <= 5 THEN 0.3::DOUBLE ELSE 0.0 END)"""


@query("conservative_fallback", f"""WITH {_BASE_SQL},
x AS (SELECT r.*, {_RISK_SQL} AS risk_factor,
  """ + ", ".join(f"b.B{i}" for i in range(1, 29)) + """ FROM requests r LEFT JOIN base b ON r.merchant_category = b.merchant_category)
SELECT request_id, risk_factor, least(0.1 + risk_factor * 0.3, 0.5) AS fraud_probability,
  greatest(0.5, 0.9 - risk_factor * 0.3) AS normal_probability, least(10 + risk_factor * 30, 50.0) AS risk_score,
  0.6::DOUBLE AS mapping_confidence, 0 AS prediction, 'acceptable' AS confidence_level, """ + ", ".join(
    f"round(coalesce(B{i}, 0.0) * (1 + least(transaction_amount / 1000, 2.0) * 0.1 + risk_factor * 0.2), 6) + 0.0 AS V{i}"
    for i in range(1, 29)) + " FROM x")
def conservative_fallback(spark, sf):
    base = K.conservative_base(views.mapping_rows(spark, sf).select("merchant_category", *V_NAMES))
    r = K.conservative_fallback(views.requests(spark, sf), base)
    return r.select("request_id", "risk_factor", "fraud_probability", "normal_probability", "risk_score",
                    "mapping_confidence", "prediction", "confidence_level", *[rnd(v, 6).alias(v) for v in V_NAMES])


_XN = [f"n_{n}" for n in INTERPRETABLE]
_XN_SQL = f"""xn AS (SELECT request_id, least(transaction_amount / 1000, 5.0::DOUBLE) AS n_amount,
  coalesce(list_position({sql_list(MERCHANTS)}, merchant_category) - 1, 9) / 10.0::DOUBLE AS n_merchant,
  coalesce(list_position(['normal','slightly_unusual','highly_unusual','foreign'], location_risk) - 1, 0) / 4.0::DOUBLE AS n_location,
  coalesce(list_position(['typical','slightly_higher','much_higher','suspicious'], spending_pattern) - 1, 0) / 4.0::DOUBLE AS n_spending,
  sin({__import__('math').pi * 2!r} * hour_of_day / 24) AS n_hour_sin, cos({__import__('math').pi * 2!r} * hour_of_day / 24) AS n_hour_cos,
  day_of_week / 7.0::DOUBLE AS n_day, is_weekend::INTEGER::DOUBLE AS n_weekend FROM requests)"""


@query("linear_fallback", f"WITH {_XN_SQL} SELECT request_id, 0.4::DOUBLE AS mapping_confidence, " + ", ".join(
    f"round({t}, 6) + 0.0 AS V{i + 1}" for i, t in enumerate(K.linear_terms(_XN))) + " FROM xn")
def linear_fallback(spark, sf):
    x = input_enrichment(views.requests(spark, sf))
    x = x.select("request_id", *[F.col("xn")[i].alias(c) for i, c in enumerate(_XN)])
    r = K.linear_fallback(x, _XN)
    return r.select("request_id", "mapping_confidence", *[rnd(v, 6).alias(v) for v in V_NAMES])


@query("average_fallback", "SELECT request_id, 0.5::DOUBLE AS mapping_confidence, " + ", ".join(
    f"round((SELECT avg({v}) FROM txn), 6) AS {v}" for v in V_NAMES) + " FROM requests")
def average_fallback(spark, sf):
    r = K.average_fallback(views.requests(spark, sf).select("request_id"), views.txn(spark, sf))
    return r.select("request_id", "mapping_confidence", *[rnd(v, 6).alias(v) for v in V_NAMES])


@query("fallback_chain", f"""SELECT request_id, error_category,
  CASE WHEN error_category IN ('feature_mapping', 'prediction', 'model_loading') AND location_risk IS NOT NULL
            AND spending_pattern IS NOT NULL THEN 'conservative_mapping'
       WHEN error_category IN ('feature_mapping') THEN 'dataset_average' END AS strategy,
  CASE WHEN error_category IN ('feature_mapping', 'prediction', 'model_loading') THEN true ELSE false END AS recovered,
  CASE WHEN error_category IN ('feature_mapping', 'prediction', 'model_loading') THEN 0.6 END::DOUBLE AS mapping_confidence
FROM (SELECT *, {K.ERROR_CATEGORY} AS error_category FROM requests) WHERE error_category IS NOT NULL""")
def fallback_chain(spark, sf):
    r = K.fallback_chain(views.requests(spark, sf))
    return r.select("request_id", "error_category", "strategy", "recovered",
                    F.col("mapping_confidence").cast("double").alias("mapping_confidence"))


@query("narrate_request", f"SELECT request_id, {K.NARRATIVE} AS narrative FROM (SELECT *, {R.CONSISTENCY} AS input_consistency FROM requests)")
def narrate_request(spark, sf):
    r = R.consistency(views.requests(spark, sf))
    return r.select("request_id", F.expr(K.NARRATIVE).alias("narrative"))


_CONTRIB_SQL = ("c AS (SELECT request_id, " + ", ".join(
    f"round(abs({x}) / nullif(" + " + ".join(f"abs({y})" for y in _XN) + f", 0), 12) AS c_{n}" for x, n in zip(_XN, INTERPRETABLE))
    + " FROM xn)")


@query("narrate_mapping", f"""WITH {_XN_SQL}, {_CONTRIB_SQL},
l AS (SELECT request_id, name, v, o FROM (SELECT request_id, """ + ", ".join(
    f"struct_pack(v := c_{n}, o := {i}) AS {n}" for i, n in enumerate(INTERPRETABLE)) + """ FROM c)
  UNPIVOT (s FOR name IN (""" + ", ".join(INTERPRETABLE) + """)) , LATERAL (SELECT s.v AS v, s.o AS o)),
t AS (SELECT request_id, string_agg(name, ',' ORDER BY v DESC, o) FILTER (WHERE rk <= 3) AS top_factors FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC NULLS LAST, o) AS rk FROM l) GROUP BY request_id)
SELECT m.request_id, t.top_factors, CASE WHEN (""" + K.COMPONENT_SUMMARY["high_magnitude_count"] + """) > 5
  THEN 'high_magnitude_components' ELSE 'components_in_normal_range' END AS mapping_note
FROM mapping_rows m JOIN t ON m.request_id = t.request_id""")
def narrate_mapping(spark, sf):
    x = input_enrichment(views.mapping_rows(spark, sf))
    x = x.select("*", *[F.col("xn")[i].alias(c) for i, c in enumerate(_XN)])
    tot = "(" + " + ".join(f"abs({y})" for y in _XN) + ")"
    # contributions rounded to 12 dp so 1-ulp differences of sin/cos never reorder ties
    x = x.select("*", *[F.round(F.expr(f"abs({c}) / nullif({tot}, 0)"), 12).alias(f"c_{n}") for c, n in zip(_XN, INTERPRETABLE)])
    r = K.narrate_mapping(x, [f"c_{n}" for n in INTERPRETABLE], INTERPRETABLE)
    return r.select("request_id", "top_factors", "mapping_note")


@query("component_summary", "SELECT request_id, " + ", ".join(
    f"CAST({e} AS INTEGER) AS {k}" if k not in ("mean_absolute_value", "max_component") else
    (f"round({e}, 9) AS {k}" if k == "mean_absolute_value" else f"{e} AS {k}")
    for k, e in K.COMPONENT_SUMMARY.items()) + " FROM mapping_rows")
def component_summary(spark, sf):
    m = views.mapping_rows(spark, sf)
    cols = []
    for k, e in K.COMPONENT_SUMMARY.items():
        c = F.expr(e)
        cols.append((rnd(c, 9) if k == "mean_absolute_value" else c if k == "max_component" else c.cast("int")).alias(k))
    return m.select("request_id", *cols)


@query("interval_summary", "SELECT request_id, " + ", ".join(
    f"CAST({e} AS INTEGER) AS {k}" if k == "high_uncertainty_count" else f"round({e}, 9) AS {k}"
    for k, e in K.INTERVAL_SUMMARY.items()) + " FROM mapping_rows")
def interval_summary(spark, sf):
    m = views.mapping_rows(spark, sf)
    return m.select("request_id", *[(F.expr(e).cast("int") if k == "high_uncertainty_count" else rnd(F.expr(e), 9)).alias(k)
                                    for k, e in K.INTERVAL_SUMMARY.items()])


@query("request_recommendations", f"SELECT request_id, {K.RECOMMENDATIONS} AS recommendations FROM mapping_rows")
def request_recommendations(spark, sf):
    return views.mapping_rows(spark, sf).select("request_id", F.expr(K.RECOMMENDATIONS).alias("recommendations"))


@query("input_hash", f"SELECT request_id, sha256({K.INPUT_HASH_TEXT.replace('AS STRING', 'AS VARCHAR')}) AS input_hash FROM requests")
def input_hash(spark, sf):
    return K.input_hash(views.requests(spark, sf)).select("request_id", "input_hash")


_MAPPER = "['random_forest', 'xgboost', 'ensemble'][request_id % 3 + 1]"


@query("request_key", f"SELECT request_id, md5({K.request_key_text(_MAPPER).replace('AS STRING', 'AS VARCHAR')}) AS request_key FROM requests")
def request_key(spark, sf):
    r = views.requests(spark, sf).withColumn(
        "mapper_type", F.element_at(F.array(F.lit("random_forest"), F.lit("xgboost"), F.lit("ensemble")),
                                    (F.col("request_id") % 3 + 1).cast("int")))
    return K.request_key(r).select("request_id", "request_key")


@query("canonical_ids", """SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS audit_id,
  'alert_' || event_type || '_' || CAST(floor(epoch(ts))::BIGINT AS VARCHAR) AS alert_id,
  'u' || CAST(user_id AS VARCHAR) || '_v1.' || CAST(event_id % 7 AS VARCHAR) || '_' || CAST(floor(epoch(ts))::BIGINT AS VARCHAR) AS version_id
FROM events""")
def canonical_ids(spark, sf):
    """Deterministic audit / alert / version ids (md5 and epoch in place of random uuids)."""
    from riskframe.sources.tables import table
    from riskframe.sources.views import epoch_micros
    ev = table(spark, sf, "events")
    secs = F.floor(epoch_micros(F.col("ts")) / 1000000).cast("long").cast("string")
    return ev.select("event_id", F.md5(F.col("event_id").cast("string")).alias("audit_id"),
                     F.concat(F.lit("alert_"), "event_type", F.lit("_"), secs).alias("alert_id"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_v1."),
                              (F.col("event_id") % 7).cast("string"), F.lit("_"), secs).alias("version_id"))
