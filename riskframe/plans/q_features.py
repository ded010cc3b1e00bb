"""Catalog: feature engineering and scaling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import features as fe
from riskframe.operators import sampling
from riskframe.plans.catalog import query
from riskframe.sources import views

TWO_PI = repr(2 * math.pi)


def q(c):
    return f'"{c}"' if c == "Time" else c


@query("time_features", f"""
SELECT event_id, h AS "Hour", fmod("Time" / 86400, 7.0) AS "Day",
  round(sin({TWO_PI} * h / 24), 9) + 0.0 AS "Time_sin", round(cos({TWO_PI} * h / 24), 9) + 0.0 AS "Time_cos"
FROM (SELECT event_id, "Time", fmod("Time" / 3600, 24.0) AS h FROM txn)""")
def time_features(spark, sf):
    x = fe.time_features(views.txn(spark, sf).select("event_id", "Time"))
    return x.select("event_id", "Hour", "Day", *[rnd(c, 9).alias(c) for c in ["Time_sin", "Time_cos"]])


@query("amount_features", "SELECT event_id, round(ln(1 + Amount), 9) AS Amount_log, "
                          "round(sqrt(Amount), 9) AS Amount_sqrt FROM txn")
def amount_features(spark, sf):
    x = fe.amount_features(views.txn(spark, sf).select("event_id", "Amount"))
    return x.select("event_id", rnd("Amount_log", 9).alias("Amount_log"), rnd("Amount_sqrt", 9).alias("Amount_sqrt"))


@query("amount_bins", """
WITH m AS (SELECT min(Amount) AS lo, max(Amount) AS hi FROM txn)
SELECT event_id, CAST(least(greatest(ceil((Amount - lo) / ((hi - lo) / 10.0::DOUBLE)) - 1, 0), 9) AS INTEGER) AS Amount_bin
FROM txn, m""")
def amount_bins(spark, sf):
    return fe.amount_bins(views.txn(spark, sf).select("event_id", "Amount")).select("event_id", "Amount_bin")


_V5 = [f"V{i}" for i in range(1, 6)]
_INTER = [(a, b) for i, a in enumerate(_V5) for b in _V5[i + 1:]]


@query("interactions", "SELECT event_id, " + ", ".join(f"{a} * {b} AS {a}_{b}_interaction" for a, b in _INTER) + " FROM txn")
def interactions(spark, sf):
    x = fe.interactions(views.txn(spark, sf).select("event_id", *_V5))
    return x.select("event_id", *[f"{a}_{b}_interaction" for a, b in _INTER])


_TC = """CAST(floor(fmod("Time" / 3600, 24.0)) AS INTEGER) AS hour_of_day,
  CAST(floor(fmod("Time" / 86400, 7.0)) AS INTEGER) AS day_of_week,
  floor(fmod("Time" / 86400, 7.0)) >= 5 AS is_weekend"""


@query("time_context", f"SELECT event_id, {_TC} FROM txn")
def time_context(spark, sf):
    return fe.time_context(views.txn(spark, sf).select("event_id", "Time")).select(
        "event_id", "hour_of_day", "day_of_week", "is_weekend")


_MER = ("CASE WHEN Amount < 50 THEN 'grocery' WHEN Amount < 200 THEN 'restaurant' "
        "WHEN Amount < 500 THEN 'department_store' ELSE 'online' END")
_LOC = ("CASE WHEN s < 0.5 THEN 'normal' WHEN s < 1.0 THEN 'slightly_unusual' "
        "WHEN s < 2.0 THEN 'highly_unusual' ELSE 'foreign' END")
_SPD = ("CASE WHEN z < 1.0 THEN 'typical' WHEN z < 2.0 THEN 'slightly_higher' "
        "WHEN z < 3.0 THEN 'much_higher' ELSE 'suspicious' END")
_SZ = "(abs(V1) + abs(V2) + abs(V3) + abs(V14)) / 4 AS s, (abs(V4) + abs(V11) + abs(V12)) / 3 + ln(1 + Amount) / 10 AS z"


@query("merchant_by_amount", f"SELECT event_id, {_MER} AS merchant_category FROM txn")
def merchant_by_amount(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", fe.merchant_by_amount(F.col("Amount")).alias("merchant_category"))


@query("location_bucket", f"SELECT event_id, {_LOC} AS location_risk FROM (SELECT event_id, {_SZ} FROM txn)")
def location_bucket(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", fe.location_bucket(t).alias("location_risk"))


@query("spending_bucket", f"SELECT event_id, {_SPD} AS spending_pattern FROM (SELECT event_id, {_SZ} FROM txn)")
def spending_bucket(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", fe.spending_bucket(t).alias("spending_pattern"))


@query("label_clusters", """
SELECT cluster, round(avg_amount, 6) AS avg_amount, round(fraud_rate, 9) AS fraud_rate,
  CASE WHEN avg_amount < 50 THEN (CASE WHEN fraud_rate > 0.005 THEN 'atm' ELSE 'grocery' END)
       WHEN avg_amount < 200 THEN (CASE WHEN fraud_rate > 0.003 THEN 'gas' ELSE 'restaurant' END)
       WHEN avg_amount < 500 THEN 'department_store' WHEN avg_amount < 1000 THEN 'online'
       ELSE (CASE WHEN fraud_rate > 0.01 THEN 'travel' ELSE 'entertainment' END) END AS merchant_category
FROM (SELECT CAST(event_id % 10 AS INTEGER) AS cluster, avg(Amount) AS avg_amount, avg(Class::DOUBLE) AS fraud_rate
      FROM txn GROUP BY 1)""")
def label_clusters(spark, sf):
    t = views.txn(spark, sf).withColumn("cluster", (F.col("event_id") % 10).cast("int"))
    r = fe.label_clusters(t)
    return r.select("cluster", rnd("avg_amount").alias("avg_amount"), rnd("fraud_rate", 9).alias("fraud_rate"),
                    "merchant_category")


@query("mapping_training_set", f"""
SELECT event_id, {_TC}, Amount AS transaction_amount, {_MER} AS merchant_category,
  {_LOC} AS location_risk, {_SPD} AS spending_pattern,
  CAST(list_position(['grocery','gas','online','restaurant','atm','department_store','pharmacy','entertainment','travel','other'], {_MER}) - 1 AS INTEGER) AS merchant_ordinal,
  CAST(list_position(['normal','slightly_unusual','highly_unusual','foreign'], {_LOC}) - 1 AS INTEGER) AS location_ordinal,
  CAST(list_position(['typical','slightly_higher','much_higher','suspicious'], {_SPD}) - 1 AS INTEGER) AS spending_ordinal
FROM (SELECT *, {_SZ} FROM txn)""")
def mapping_training_set(spark, sf):
    x = fe.mapping_training_set(views.txn(spark, sf))
    return x.select("event_id", "hour_of_day", "day_of_week", "is_weekend", "transaction_amount",
                    "merchant_category", "location_risk", "spending_pattern", "merchant_ordinal",
                    "location_ordinal", "spending_ordinal")


# ---- scalers: fit on the stratified train split, apply to every row ----------------------

_SPLIT_SQL = ("SELECT *, CASE WHEN row_number() OVER (PARTITION BY Class ORDER BY md5('42_' || event_id::VARCHAR), event_id) "
              "<= round(0.2 * count(*) OVER (PARTITION BY Class)) THEN 'test' ELSE 'train' END AS split FROM txn")


def _split(spark, sf):
    t = views.txn(spark, sf).select("event_id", *FEATURES, "Class")
    s = sampling.stratified_split(t, "Class", "event_id", 0.2, 42)
    return s, s.filter(F.col("split") == "train")


@query("scale_standard", f"""
WITH s AS ({_SPLIT_SQL}),
st AS (SELECT {", ".join(f"avg({q(c)}) AS mu_{c}, CASE WHEN stddev_pop({q(c)}) = 0 THEN 1.0 ELSE stddev_pop({q(c)}) END AS sd_{c}" for c in FEATURES)}
       FROM s WHERE split = 'train')
SELECT event_id, split, {", ".join(f"round(({q(c)} - mu_{c}) / sd_{c}, 9) + 0.0 AS {q(c)}" for c in FEATURES)} FROM s, st""")
def scale_standard(spark, sf):
    s, train = _split(spark, sf)
    x = fe.scale_standard(s, train, FEATURES)
    return x.select("event_id", "split", *[rnd(c, 9).alias(c) for c in FEATURES])


@query("scale_minmax", f"""
WITH s AS ({_SPLIT_SQL}),
st AS (SELECT {", ".join(f"min({q(c)}) AS lo_{c}, max({q(c)}) AS hi_{c}" for c in FEATURES)} FROM s WHERE split = 'train')
SELECT event_id, split, {", ".join(f"round(CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({q(c)} - lo_{c}) / (hi_{c} - lo_{c}) END, 9) + 0.0 AS {q(c)}" for c in FEATURES)} FROM s, st""")
def scale_minmax(spark, sf):
    s, train = _split(spark, sf)
    x = fe.scale_minmax(s, train, FEATURES)
    return x.select("event_id", "split", *[rnd(c, 9).alias(c) for c in FEATURES])


@query("scale_robust", f"""
WITH s AS ({_SPLIT_SQL}),
st AS (SELECT {", ".join(f"quantile_cont({q(c)}, 0.5) AS md_{c}, quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25) AS iq_{c}" for c in FEATURES)}
       FROM s WHERE split = 'train')
SELECT event_id, split, {", ".join(f"round(({q(c)} - md_{c}) / CASE WHEN iq_{c} = 0 THEN 1.0 ELSE iq_{c} END, 9) + 0.0 AS {q(c)}" for c in FEATURES)} FROM s, st""")
def scale_robust(spark, sf):
    s, train = _split(spark, sf)
    x = fe.scale_robust(s, train, FEATURES)
    return x.select("event_id", "split", *[rnd(c, 9).alias(c) for c in FEATURES])


@query("target_scaling", f"""
WITH s AS ({_SPLIT_SQL}),
st AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}" for c in V_NAMES)}
       FROM s WHERE split = 'train')
SELECT event_id, {", ".join(f"round(({c} - mu_{c}) / sd_{c}, 9) + 0.0 AS z_{c}, round((({c} - mu_{c}) / sd_{c}) * sd_{c} + mu_{c}, 6) + 0.0 AS r_{c}" for c in V_NAMES)} FROM s, st""")
def target_scaling(spark, sf):
    s, train = _split(spark, sf)
    z, stats = fe.target_scaling(s.select("event_id", *V_NAMES), train, V_NAMES)
    zr = z.select("event_id", "_st", *[F.col(c).alias(f"z_{c}") for c in V_NAMES], *V_NAMES)
    back = fe.inverse_target_scaling(zr, stats, V_NAMES)
    return back.select("event_id", *[rnd(f"z_{c}", 9).alias(f"z_{c}") for c in V_NAMES],
                       *[rnd(c, 6).alias(f"r_{c}") for c in V_NAMES])
