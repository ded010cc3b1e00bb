"""Catalog: alignment and encodings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, LOCATIONS, MERCHANTS, SPENDING, V_NAMES, sql_list
from riskframe.operators import align
from riskframe.plans.catalog import query
from riskframe.sources import views

TWO_PI = repr(2 * math.pi)


def _feat_sql(c):
    return '"Time"' if c == "Time" else c


@query("align_features",
       "SELECT event_id, " + ", ".join(
           "0.0::DOUBLE AS " + _feat_sql(c) if c in ("V5", "V17") else f"coalesce({_feat_sql(c)}, 0.0) AS {_feat_sql(c)}"
           for c in FEATURES) + " FROM txn")
def align_features(spark, sf):
    t = views.txn(spark, sf).drop("V5", "V17")      # two features absent, extras present
    return align.align_features(t, FEATURES, keep=["event_id"])


@query("feature_label_split", "SELECT event_id, " + ", ".join(_feat_sql(c) for c in FEATURES) + " FROM txn")
def feature_label_split(spark, sf):
    t = views.txn(spark, sf).select("event_id", *FEATURES, "Class")
    x, _y = align.feature_label_split(t, "Class")
    return x


def raw_requests(spark, sf):
    """Request bodies as JSON text, with fields left out by rule (missing-field cases)."""
    r = views.requests(spark, sf)
    rid = F.col("request_id")
    body = F.to_json(F.struct(
        "transaction_amount",
        F.when(rid % 11 != 0, F.col("merchant_category")).alias("merchant_category"),
        F.when(rid % 13 != 0, F.col("hour_of_day")).alias("hour_of_day"),
        "day_of_week",
        F.when(rid % 3 != 0, F.col("is_weekend")).alias("is_weekend"),
        "location_risk",
        F.when(rid % 17 != 0, F.col("spending_pattern")).alias("spending_pattern")))
    return r.select("request_id", body.alias("body"))


@query("parse_requests", """
SELECT request_id, transaction_amount,
  CASE WHEN request_id % 11 <> 0 THEN merchant_category END AS merchant_category,
  CASE WHEN request_id % 13 <> 0 THEN hour_of_day END AS hour_of_day, day_of_week,
  CASE WHEN request_id % 3 <> 0 THEN is_weekend ELSE day_of_week >= 5 END AS is_weekend,
  false AS is_holiday, location_risk,
  CASE WHEN request_id % 17 <> 0 THEN spending_pattern END AS spending_pattern,
  concat_ws(',', CASE WHEN request_id % 11 = 0 THEN 'merchant_category' END,
                 CASE WHEN request_id % 13 = 0 THEN 'hour_of_day' END,
                 CASE WHEN request_id % 17 = 0 THEN 'spending_pattern' END) AS missing_fields
FROM requests""")
def parse_requests(spark, sf):
    p = align.parse_requests(raw_requests(spark, sf), keep=["request_id"])
    return p.withColumn("missing_fields", F.array_join("missing_fields", ","))


@query("reject_invalid", f"""
SELECT request_id, CASE
  WHEN NOT (hour_of_day BETWEEN 0 AND 23) THEN 'hour_out_of_range'
  WHEN NOT (day_of_week BETWEEN 0 AND 6) THEN 'day_out_of_range'
  WHEN transaction_amount < 0 THEN 'negative_amount' END AS reject_reason,
  CASE WHEN (hour_of_day BETWEEN 0 AND 23) AND (day_of_week BETWEEN 0 AND 6) AND transaction_amount >= 0
       THEN 'accepted' ELSE 'rejected' END AS status
FROM requests""")
def reject_invalid(spark, sf):
    r = align.reject_invalid(views.requests(spark, sf))
    return r.select("request_id", "reject_reason",
                    F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected").alias("status"))


@query("encode_ordinals", f"""
SELECT request_id, CAST(list_position({sql_list(MERCHANTS)}, merchant_category) - 1 AS INTEGER) AS merchant_ordinal,
  CAST(list_position({sql_list(LOCATIONS)}, location_risk) - 1 AS INTEGER) AS location_ordinal,
  CAST(list_position({sql_list(SPENDING)}, spending_pattern) - 1 AS INTEGER) AS spending_ordinal FROM requests""")
def encode_ordinals(spark, sf):
    return align.encode_ordinals(views.requests(spark, sf)).select(
        "request_id", "merchant_ordinal", "location_ordinal", "spending_ordinal")


_IV_SQL = f"""
SELECT request_id, transaction_amount AS f_amount,
  CAST(list_position({sql_list(MERCHANTS)}, merchant_category) - 1 AS DOUBLE) AS f_merchant,
  CAST(list_position({sql_list(LOCATIONS)}, location_risk) - 1 AS DOUBLE) AS f_location,
  CAST(list_position({sql_list(SPENDING)}, spending_pattern) - 1 AS DOUBLE) AS f_spending,
  (round(sin({TWO_PI} * hour_of_day / 24), 9) + 0.0) AS f_hour_sin, (round(cos({TWO_PI} * hour_of_day / 24), 9) + 0.0) AS f_hour_cos,
  day_of_week::DOUBLE AS f_day, is_weekend::INTEGER::DOUBLE AS f_weekend FROM requests"""


def _explode_vec(df, vec, names, prefix):
    return df.select("request_id", *[(F.round(F.col(vec)[i], 9) if n.startswith("hour_") else F.col(vec)[i]).alias(f"{prefix}{n}")
                                     for i, n in enumerate(names)])


@query("interpretable_vector", _IV_SQL)
def interpretable_vector(spark, sf):
    x = align.interpretable_vector(views.requests(spark, sf))
    return _explode_vec(x, "x", align.INTERPRETABLE, "f_")


@query("context_time", "SELECT request_id, (day_of_week * 86400 + hour_of_day * 3600 + 2619)::DOUBLE AS \"Time\" FROM requests")
def context_time(spark, sf):
    return align.context_time(views.requests(spark, sf)).select("request_id", "Time")


_AV_SQL = """
WITH a AS (
  SELECT r.request_id, [(r.day_of_week * 86400 + r.hour_of_day * 3600 + 2619)::DOUBLE] ||
         [""" + ", ".join(f"m.M{i}" for i in range(1, 29)) + """] || [r.transaction_amount] AS features
  FROM requests r JOIN mapped m ON r.request_id = m.event_id)
SELECT request_id, CAST(i - 1 AS INTEGER) AS pos, features[i] AS value FROM a, range(1, 31) t(i)"""


@query("assemble_vector", _AV_SQL)
def assemble_vector(spark, sf):
    r = align.context_time(views.requests(spark, sf))
    m = views.mapped(spark, sf)
    j = r.join(m, r.request_id == m.event_id).withColumn("v", F.array(*[f"M{i}" for i in range(1, 29)]))
    a = align.assemble_vector(j, "v", "Time", "transaction_amount")
    return a.select("request_id", F.posexplode("features").alias("pos", "value")) \
        .withColumn("pos", F.col("pos").cast("int"))


@query("vector_to_map", "SELECT event_id, name, value FROM (SELECT event_id, " + ", ".join(
    f'"{c}"' if c == "Time" else c for c in FEATURES) + " FROM txn) UNPIVOT (value FOR name IN (" + ", ".join(
    f'"{c}"' if c == "Time" else c for c in FEATURES) + "))")
def vector_to_map(spark, sf):
    t = views.txn(spark, sf).withColumn("vec", F.array(*FEATURES))
    m = align.vector_to_map(t, "vec", FEATURES)
    return m.select("event_id", F.explode("named").alias("name", "value"))


_IE_SQL = f"""
SELECT request_id, least(transaction_amount / 1000, 5.0::DOUBLE) AS n_amount,
  coalesce(list_position({sql_list(MERCHANTS)}, merchant_category) - 1, 9) / 10.0::DOUBLE AS n_merchant,
  coalesce(list_position({sql_list(LOCATIONS)}, location_risk) - 1, 0) / 4.0::DOUBLE AS n_location,
  coalesce(list_position({sql_list(SPENDING)}, spending_pattern) - 1, 0) / 4.0::DOUBLE AS n_spending,
  (round(sin({TWO_PI} * hour_of_day / 24), 9) + 0.0) AS n_hour_sin, (round(cos({TWO_PI} * hour_of_day / 24), 9) + 0.0) AS n_hour_cos,
  day_of_week / 7.0::DOUBLE AS n_day, is_weekend::INTEGER::DOUBLE AS n_weekend FROM requests"""


@query("input_enrichment", _IE_SQL)
def input_enrichment(spark, sf):
    x = align.input_enrichment(views.requests(spark, sf))
    return _explode_vec(x, "xn", align.INTERPRETABLE, "n_")
