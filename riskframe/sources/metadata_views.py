"""Stand-in metadata tables: mapping operations + audit star, model registry, performance
history, experiments.  All derived from the given tables (requests/scored, part, events),
so their size grows with the data.  ``VIEW_SQL`` is the DuckDB text of each view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources import views
from riskframe.sources.tables import table

VIEW_SQL: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}

MAPPERS = ["random_forest", "xgboost", "ensemble"]


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping operation per request: status error when amount <= 0, otherwise a result
    (latency = event value, confidence = 1 - p/2, prediction, probability)."""
    return operations_of(views.request_scores(spark, sf_dir))


def operations_of(j: DataFrame) -> DataFrame:
    """As ``operations``, of any scored requests, arriving ones too."""
    err = F.col("transaction_amount") <= 0
    return j.select(
        F.md5(F.col("request_id").cast("string")).alias("audit_id"), "request_id", "ts",
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "transaction_amount", "merchant_category", "hour_of_day", "day_of_week", "is_weekend", "location_risk",
        "spending_pattern",
        F.when(~err, F.element_at(F.array(*[F.lit(m) for m in MAPPERS]), (F.col("request_id") % 3 + 1).cast("int")))
        .alias("mapping_method"),
        F.concat(F.lit("v"), (F.col("user_id") % 2 + 1).cast("string")).alias("model_version"),
        F.when(~err, F.col("value")).alias("processing_time_ms"),
        F.when(~err, 1 - F.col("p") / 2).alias("mapping_confidence"),
        F.when(~err, F.col("pred")).alias("prediction"),
        F.when(~err, F.col("p")).alias("fraud_probability"),
        F.when(err, F.lit("non_positive_amount")).alias("error_message"),
        (~err & (F.col("request_id") % 5 != 0)).alias("has_quality"))


VIEW_SQL["operations"] = """
SELECT md5(CAST(r.request_id AS VARCHAR)) AS audit_id, r.request_id, r.ts, 's' || CAST(r.user_id % 20 AS VARCHAR) AS session_id,
  CAST(r.user_id AS VARCHAR) AS user_id, r.transaction_amount, r.merchant_category, r.hour_of_day, r.day_of_week, r.is_weekend,
  r.location_risk, r.spending_pattern,
  CASE WHEN r.transaction_amount > 0 THEN ['random_forest', 'xgboost', 'ensemble'][r.request_id % 3 + 1] END AS mapping_method,
  'v' || CAST(r.user_id % 2 + 1 AS VARCHAR) AS model_version,
  CASE WHEN r.transaction_amount > 0 THEN e.value END AS processing_time_ms,
  CASE WHEN r.transaction_amount > 0 THEN 1 - s.p / 2 END AS mapping_confidence,
  CASE WHEN r.transaction_amount > 0 THEN s.pred END AS prediction,
  CASE WHEN r.transaction_amount > 0 THEN s.p END AS fraud_probability,
  CASE WHEN r.transaction_amount <= 0 THEN 'non_positive_amount' END AS error_message,
  (r.transaction_amount > 0 AND r.request_id % 5 <> 0) AS has_quality
FROM requests r JOIN scored s ON r.request_id = s.event_id JOIN events e ON r.request_id = e.event_id"""
VIEW_DEPS["operations"] = ["requests", "scored"]


def mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.operators.audit import audit_tables
    return audit_tables(operations(spark, sf_dir))["mapping_audit"]


VIEW_SQL["mapping_audit"] = """
SELECT audit_id AS id, ts AS "timestamp", session_id, user_id, 'feature_mapping' AS operation_type,
  sha256('{"amount": ' || CAST(transaction_amount AS VARCHAR) || ', "day": ' || CAST(day_of_week AS VARCHAR) || ', "hour": '
    || CAST(hour_of_day AS VARCHAR) || ', "location": "' || location_risk || '", "merchant": "' || merchant_category
    || '", "spending": "' || spending_pattern || '", "weekend": ' || (CASE WHEN is_weekend THEN 'true' ELSE 'false' END) || '}') AS input_hash,
  coalesce(mapping_method, 'unknown') AS mapper_type, model_version, coalesce(processing_time_ms, 0.0) AS processing_time_ms,
  coalesce(mapping_confidence, 0.0) AS confidence_score, coalesce(prediction, -1) AS fraud_prediction,
  coalesce(fraud_probability, 0.0) AS fraud_probability,
  CASE WHEN error_message IS NULL THEN 'success' ELSE 'error' END AS validation_status, error_message,
  CAST(ts AS DATE) AS dt
FROM operations"""
VIEW_DEPS["mapping_audit"] = ["operations"]

VIEW_SQL["quality_metrics"] = """
SELECT audit_id, 1 - fraud_probability / 4 AS correlation_preservation, 0.9 - fraud_probability / 5 AS distribution_similarity,
  0.8::DOUBLE AS prediction_consistency, fraud_probability / 3 AS mapping_uncertainty, mapping_confidence AS overall_confidence
FROM operations WHERE has_quality"""
VIEW_DEPS["quality_metrics"] = ["operations"]

VIEW_SQL["input_details"] = """
SELECT audit_id, transaction_amount, merchant_category, hour_of_day, day_of_week, CAST(is_weekend AS INTEGER) AS is_weekend,
  location_risk, spending_pattern FROM operations"""
VIEW_DEPS["input_details"] = ["operations"]


# ---- registry -----------------------------------------------------------------------------

def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration event log: every part row registers version (p_type, p_brand) at
    2024-01-01 + p_partkey minutes; a repeated id replaces the earlier row."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", "p_type", "p_brand").alias("version_id"), F.col("p_type").alias("model_type"),
                    (F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("p_partkey")))
                    .alias("registered_at"),
                    (F.col("p_size") / 50.0).alias("accuracy"), (F.col("p_retailprice") / 2100.0).alias("f1"))


VIEW_SQL["registrations"] = """
SELECT p_type || '/' || p_brand AS version_id, p_type AS model_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS registered_at,
  p_size / 50.0::DOUBLE AS accuracy, p_retailprice / 2100.0::DOUBLE AS f1 FROM part"""
VIEW_DEPS["registrations"] = []


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per version: created_at = first registration; latest metrics; auto version
    number; the newest version per type is active; the best f1 per type is production."""
    from riskframe.operators.registry import model_versions as mv
    return mv(registrations(spark, sf_dir))


VIEW_SQL["model_versions"] = """
SELECT version_id, model_type, created_at, accuracy, f1,
  '1.' || CAST(row_number() OVER (PARTITION BY model_type ORDER BY created_at, version_id) - 1 AS VARCHAR) AS version_number,
  row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, version_id DESC) = 1 AS is_active,
  row_number() OVER (PARTITION BY model_type ORDER BY f1 DESC, version_id) = 1 AS is_production
FROM (SELECT version_id, any_value(model_type) AS model_type, min(registered_at) AS created_at,
        arg_max(accuracy, registered_at) AS accuracy, arg_max(f1, registered_at) AS f1 FROM registrations GROUP BY version_id)"""
VIEW_DEPS["model_versions"] = ["registrations"]


def performance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row per (event_type, day) of events: model_id = event_type."""
    ev = table(spark, sf_dir, "events")
    g = ev.groupBy(F.col("event_type").alias("model_id"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mv"), F.stddev_pop("value").alias("sv"),
        F.max("value").alias("xv"), F.min("value").alias("nv"), F.avg((F.col("value") > 400).cast("double")).alias("er"))
    p = 0.85 + F.col("sv") / 2000
    r = 0.8 + F.col("xv") / 5000
    return g.select("model_id", "day", "n", (0.9 + F.col("mv") / 5000).alias("accuracy"), p.alias("precision"),
                    r.alias("recall"), (2 * p * r / (p + r)).alias("f1"), (0.88 + F.col("nv") / 100).alias("auc"),
                    (F.col("mv") / 1000).alias("drift"), F.col("er").alias("error_rate"))


VIEW_SQL["performance_history"] = """
SELECT model_id, day, n, 0.9 + mv / 5000 AS accuracy, 0.85 + sv / 2000 AS precision, 0.8 + xv / 5000 AS recall,
  2 * (0.85 + sv / 2000) * (0.8 + xv / 5000) / ((0.85 + sv / 2000) + (0.8 + xv / 5000)) AS f1, 0.88 + nv / 100 AS auc,
  mv / 1000 AS drift, er AS error_rate
FROM (SELECT event_type AS model_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mv, stddev_pop(value) AS sv,
        max(value) AS xv, min(value) AS nv, avg(CASE WHEN value > 400 THEN 1.0 ELSE 0.0 END) AS er FROM events GROUP BY ALL)"""
VIEW_DEPS["performance_history"] = []


def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stepped metric log: experiment per user, step = day number, two metrics per step."""
    ev = table(spark, sf_dir, "events")
    d = ev.groupBy(F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
                   F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("step")).agg(F.avg("value").alias("auc_raw"),
                                                         F.avg((F.col("event_type") == "error").cast("double")).alias("loss"))
    return d.select("experiment_id", "step", F.explode(F.array(
        F.struct(F.lit("auc").alias("metric"), (F.col("auc_raw") / 500).alias("value")),
        F.struct(F.lit("loss").alias("metric"), F.col("loss").alias("value")))).alias("kv")).select(
        "experiment_id", "step", "kv.metric", "kv.value")


VIEW_SQL["experiment_metrics"] = """
SELECT experiment_id, step, 'auc' AS metric, auc_raw / 500 AS value FROM (
  SELECT 'exp_' || CAST(user_id AS VARCHAR) AS experiment_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, avg(value) AS auc_raw,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS loss FROM events GROUP BY ALL)
UNION ALL
SELECT experiment_id, step, 'loss', loss FROM (
  SELECT 'exp_' || CAST(user_id AS VARCHAR) AS experiment_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, avg(value) AS auc_raw,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS loss FROM events GROUP BY ALL)"""
VIEW_DEPS["experiment_metrics"] = []


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment per user: status by user id, created at its first event."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.min("ts").alias("created_at"),
                                     F.avg(F.get_json_object("props", "$.k").cast("double")).alias("param_k")).select(
        F.concat(F.lit("exp_"), F.col("user_id").cast("string")).alias("experiment_id"),
        F.element_at(F.array(F.lit("running"), F.lit("completed"), F.lit("failed")), (F.col("user_id") % 3 + 1).cast("int"))
        .alias("status"), "created_at", "param_k")


VIEW_SQL["experiments"] = """
SELECT 'exp_' || CAST(user_id AS VARCHAR) AS experiment_id, ['running', 'completed', 'failed'][user_id % 3 + 1] AS status,
  min(ts) AS created_at, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS param_k FROM events GROUP BY user_id"""
VIEW_DEPS["experiments"] = []
