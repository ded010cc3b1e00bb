"""Catalog: scans, profiles and feature statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import profile
from riskframe.plans.catalog import query
from riskframe.sources import views

FILE_ORDER = ["Time"] + V_NAMES + ["Amount", "Class"]
_Q = ", ".join(f'"{c}"' if c == "Time" else c for c in FILE_ORDER)


@query("scan_transactions", f"SELECT event_id, {_Q} FROM txn")
def scan_transactions(spark, sf):
    return views.txn(spark, sf).select("event_id", *FILE_ORDER)


@query("dataset_profile",
       "SELECT count(*) AS rows, 31::BIGINT AS columns, sum(Class)::BIGINT AS positives, "
       "sum(Class) / count(*) AS positive_rate FROM txn")
def dataset_profile(spark, sf):
    return profile.dataset_profile(views.txn(spark, sf).select(*FILE_ORDER), "Class")


_ISSUE_SQL = """
WITH a AS (
  SELECT {nulls} AS n_null, {infs} AS n_inf, avg(Class::DOUBLE) AS rate,
         min(Amount) AS min_amount, min("Time") AS min_time FROM txn)
SELECT issue, n_null, n_inf, round(rate, 9) AS rate, round(min_amount, 6) AS min_amount,
       round(min_time, 6) AS min_time FROM (
  SELECT *, unnest(list_filter([
     CASE WHEN n_null > 0 THEN 'missing_values' END,
     CASE WHEN rate = 0 THEN 'no_positive_class' END,
     CASE WHEN rate > 0.1 THEN 'positive_rate_high' END,
     CASE WHEN min_amount <= 0 THEN 'non_positive_amount' END,
     CASE WHEN min_time < 0 THEN 'negative_time' END,
     CASE WHEN n_inf > 0 THEN 'infinite_values' END], lambda x: x IS NOT NULL)) AS issue FROM a)
""".format(
    nulls=" + ".join(f'count(*) FILTER (WHERE "{c}" IS NULL)' for c in FEATURES + ["Class"]),
    infs=" + ".join(f'count(*) FILTER (WHERE isinf("{c}"))' for c in FEATURES))


@query("dataset_issues", _ISSUE_SQL)
def dataset_issues(spark, sf):
    t = views.txn(spark, sf)
    r = profile.dataset_issues(t, FEATURES, "Class")
    return r.select("issue", "n_null", "n_inf", rnd("rate", 9).alias("rate"),
                    rnd("min_amount").alias("min_amount"), rnd("min_time").alias("min_time"))


def _long_sql(features, extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, \"{c}\"::DOUBLE AS value{extra} FROM txn" for c in features)


_FD_SQL = f"""
WITH long AS ({_long_sql(FEATURES, ', Class')})
SELECT feature, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
       round(min(value), 4) AS min, round(max(value), 4) AS max,
       round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS q25,
       round(quantile_cont(value, 0.75), 4) AS q75,
       round(avg(value) FILTER (WHERE Class = 1), 4) AS fraud_mean,
       round(stddev_samp(value) FILTER (WHERE Class = 1), 4) AS fraud_std,
       round(avg(value) FILTER (WHERE Class <> 1), 4) AS normal_mean,
       round(stddev_samp(value) FILTER (WHERE Class <> 1), 4) AS normal_std
FROM long GROUP BY feature
"""


@query("feature_distributions", _FD_SQL)
def feature_distributions(spark, sf):
    r = profile.feature_distributions(views.txn(spark, sf), FEATURES, "Class")
    return r.select("feature", *[rnd(c, 4).alias(c) for c in
                                 ["mean", "std", "min", "max", "median", "q25", "q75",
                                  "fraud_mean", "fraud_std", "normal_mean", "normal_std"]])


_pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
_CORR_SQL = "WITH c AS (SELECT " + ", ".join(
    f'corr("{a}", "{b}") AS c{i}' for i, (a, b) in enumerate(_pairs)) + " FROM txn) " + \
    " UNION ALL ".join(
        [f"SELECT '{a}' AS f_i, '{b}' AS f_j, round(c{i}, 6) AS corr FROM c" for i, (a, b) in enumerate(_pairs)]
        + [f"SELECT '{b}' AS f_i, '{a}' AS f_j, round(c{i}, 6) AS corr FROM c" for i, (a, b) in enumerate(_pairs)]
        + [f"SELECT '{a}' AS f_i, '{a}' AS f_j, 1.0::DOUBLE AS corr" for a in FEATURES])


@query("correlation_matrix", _CORR_SQL)
def correlation_matrix(spark, sf):
    r = profile.correlation_matrix(views.txn(spark, sf), FEATURES)
    return r.select("f_i", "f_j", rnd("corr").alias("corr"))


_BS_SQL = f"""
WITH long AS ({_long_sql(FEATURES)}),
m AS (SELECT feature, avg(value) AS mu FROM long GROUP BY feature)
SELECT l.feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
       round(min(value), 4) AS min, round(max(value), 4) AS max,
       round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50,
       round(quantile_cont(value, 0.75), 4) AS q75,
       round(avg(power(value - mu, 3)) / power(avg(power(value - mu, 2)), 1.5), 6) AS skewness,
       round(kurtosis_pop(value), 6) AS kurtosis
FROM long l JOIN m ON l.feature = m.feature GROUP BY l.feature
"""


@query("baseline_stats", _BS_SQL)
def baseline_stats(spark, sf):
    r = profile.baseline_stats(views.txn(spark, sf), FEATURES)
    return r.select("feature", *[rnd(c, 4).alias(c) for c in ["mean", "std", "min", "max", "q25", "q50", "q75"]],
                    rnd("skewness").alias("skewness"), rnd("kurtosis").alias("kurtosis"))


_PD_SQL = """
WITH o AS (SELECT count(*) AS n, avg(pred::DOUBLE) AS pred_mean, stddev_pop(pred::DOUBLE) AS pred_std,
                  avg(greatest(p, 1 - p)) AS conf_mean, stddev_pop(greatest(p, 1 - p)) AS conf_std,
                  count(*) FILTER (WHERE greatest(p, 1 - p) < 0.6) AS low_conf,
                  count(*) FILTER (WHERE greatest(p, 1 - p) > 0.9) AS high_conf FROM scored),
c AS (SELECT pred, count(*) AS class_count FROM scored GROUP BY pred)
SELECT c.pred, c.class_count, round(c.class_count * 100.0 / o.n, 6) AS class_pct,
       round(pred_mean, 6) AS pred_mean, round(pred_std, 6) AS pred_std, round(conf_mean, 6) AS conf_mean,
       round(conf_std, 6) AS conf_std, low_conf, high_conf FROM c, o
"""


@query("prediction_distribution", _PD_SQL)
def prediction_distribution(spark, sf):
    r = profile.prediction_distribution(views.scored(spark, sf))
    return r.select("pred", "class_count", *[rnd(c).alias(c) for c in
                                             ["class_pct", "pred_mean", "pred_std", "conf_mean", "conf_std"]],
                    "low_conf", "high_conf")


@query("confidence_bands",
       "SELECT round(avg((p >= 0 AND p < 0.3)::DOUBLE), 9) AS low_share, "
       "round(avg((p >= 0.3 AND p < 0.7)::DOUBLE), 9) AS medium_share, "
       "round(avg((p >= 0.7 AND p <= 1.0)::DOUBLE), 9) AS high_share FROM scored")
def confidence_bands(spark, sf):
    r = profile.confidence_bands(views.scored(spark, sf))
    return r.select(*[rnd(c, 9).alias(c) for c in r.columns])


@query("rate_metrics",
       "SELECT count(*) AS n, round(avg(y::DOUBLE), 9) AS fraud_rate, "
       "round(avg(pred::DOUBLE), 9) AS predicted_rate FROM scored")
def rate_metrics(spark, sf):
    r = profile.rate_metrics(views.scored(spark, sf))
    return r.select("n", rnd("fraud_rate", 9).alias("fraud_rate"), rnd("predicted_rate", 9).alias("predicted_rate"))
