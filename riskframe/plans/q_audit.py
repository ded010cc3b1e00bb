"""Catalog: audit star and its analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import audit as AU
from riskframe.operators import risk as K
from riskframe.plans.catalog import query
from riskframe.session import checkpoint_dir
from riskframe.sources import metadata_views as MV


def _tables(spark, sf):
    return AU.audit_tables(MV.operations(spark, sf))


def _through(df, fmt):
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/audit-{fmt}-{uuid.uuid4().hex}"
    return AU.exported(df.sparkSession, path, fmt, df.schema) if AU.export(df, path, fmt) else df.limit(0)


_HEADER_COLS = ["id", "timestamp", "session_id", "user_id", "operation_type", "input_hash", "mapper_type", "model_version",
                "processing_time_ms", "confidence_score", "fraud_prediction", "fraud_probability", "validation_status",
                "error_message", "dt"]


@query("audit_tables", "SELECT " + ", ".join(f'"{c}"' for c in _HEADER_COLS) + " FROM mapping_audit")
def audit_tables(spark, sf):
    return _tables(spark, sf)["mapping_audit"].select(*_HEADER_COLS)


@query("audit_enriched", """SELECT h.id, h."timestamp", h.mapper_type, d.transaction_amount, d.merchant_category,
  q.correlation_preservation, q.overall_confidence FROM mapping_audit h LEFT JOIN input_details d ON h.id = d.audit_id
  LEFT JOIN quality_metrics q ON h.id = q.audit_id""")
def audit_enriched(spark, sf):
    """Header left-joined with input details and quality metrics on the audit id."""
    t = _tables(spark, sf)
    h, d, q = t["mapping_audit"], t["input_details"], t["quality_metrics"].withColumnRenamed("audit_id", "q_id")
    j = h.join(d, h.id == d.audit_id, "left").join(q, h.id == F.col("q_id"), "left")
    return j.select("id", "timestamp", "mapper_type", "transaction_amount", "merchant_category",
                    "correlation_preservation", "overall_confidence")


_SUMMARY_SQL = """SELECT h.id AS audit_id, h."timestamp", h.operation_type, h.mapper_type, d.transaction_amount, d.merchant_category,
  h.confidence_score, h.fraud_prediction, h.fraud_probability, h.processing_time_ms, h.validation_status
  FROM mapping_audit h JOIN input_details d ON h.id = d.audit_id"""


@query("audit_summary_csv", _SUMMARY_SQL)
def audit_summary_csv(spark, sf):
    """The summary rows written as CSV; the rows that the files hold."""
    t = _tables(spark, sf)
    return _through(AU.audit_summary(t["mapping_audit"], t["input_details"]), "csv")


@query("audit_jsonl")
def audit_jsonl(spark, sf):
    """S05 (rows-only: JSON text formatting is engine-specific)."""
    return AU.audit_jsonl(MV.operations(spark, sf))


@query("audit_filter", """SELECT id, "timestamp", mapper_type FROM mapping_audit
  WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00' AND mapper_type = 'xgboost'""")
def audit_filter(spark, sf):
    h = _tables(spark, sf)["mapping_audit"]
    return AU.audit_filter(h, "2024-01-05 00:00:00", "2024-01-20 00:00:00", "xgboost").select("id", "timestamp", "mapper_type")


@query("latest_audit", """SELECT id, "timestamp", mapper_type, confidence_score FROM mapping_audit ORDER BY "timestamp" DESC, id LIMIT 1000""")
def latest_audit(spark, sf):
    return AU.latest(_tables(spark, sf)["mapping_audit"], 1000).select("id", "timestamp", "mapper_type", "confidence_score")


@query("audit_export", f"""SELECT * FROM ({_SUMMARY_SQL}
  WHERE h."timestamp" >= TIMESTAMP '2024-01-03 00:00:00' AND h."timestamp" <= TIMESTAMP '2024-01-28 00:00:00'
  ORDER BY h."timestamp" DESC, h.id LIMIT 10000)""")
def audit_export(spark, sf):
    """The newest rows of a date range written as JSON; the rows that the files hold."""
    t = _tables(spark, sf)
    return _through(AU.audit_export(t["mapping_audit"], t["input_details"], "2024-01-03 00:00:00", "2024-01-28 00:00:00", 10000), "json")


@query("audit_statistics", """SELECT CASE WHEN grouping(mapper_type) = 0 THEN 'mapper' WHEN grouping(validation_status) = 0 THEN 'status'
    WHEN grouping(pred) = 0 THEN 'prediction' ELSE 'total' END AS grouping_key,
  coalesce(mapper_type, validation_status, CAST(pred AS VARCHAR)) AS grouping_value, count(*) AS count,
  CASE WHEN grouping(mapper_type) = 1 AND grouping(validation_status) = 1 AND grouping(pred) = 1 THEN round(avg(confidence_score), 3) END AS avg_confidence,
  CASE WHEN grouping(mapper_type) = 1 AND grouping(validation_status) = 1 AND grouping(pred) = 1 THEN round(avg(processing_time_ms), 2) END AS avg_latency_ms,
  CASE WHEN grouping(mapper_type) = 1 AND grouping(validation_status) = 1 AND grouping(pred) = 1
       THEN round(sum(CASE WHEN validation_status = 'success' THEN 1 ELSE 0 END) * 100.0 / greatest(count(*), 1), 2) END AS success_rate
FROM (SELECT *, CASE WHEN fraud_prediction <> -1 THEN fraud_prediction END AS pred FROM mapping_audit)
GROUP BY GROUPING SETS ((mapper_type), (validation_status), (pred), ())
HAVING NOT (grouping(pred) = 0 AND pred IS NULL)""")
def audit_statistics(spark, sf):
    r = AU.audit_statistics(_tables(spark, sf)["mapping_audit"])
    return r.select("grouping_key", "grouping_value", "count", F.col("avg_confidence").cast("double").alias("avg_confidence"),
                    F.col("avg_latency_ms").cast("double").alias("avg_latency_ms"),
                    F.col("success_rate").cast("double").alias("success_rate"))


@query("audit_retention", """WITH c AS (SELECT date_trunc('day', max("timestamp")) - INTERVAL 7 DAY AS cutoff FROM mapping_audit)
SELECT count(*) FILTER (WHERE "timestamp" < cutoff) AS deleted, count(*) FILTER (WHERE "timestamp" >= cutoff) AS kept,
  (SELECT count(*) FROM quality_metrics q JOIN mapping_audit h ON q.audit_id = h.id, c WHERE h."timestamp" < c.cutoff) AS deleted_quality
FROM mapping_audit, c""")
def audit_retention(spark, sf):
    """J06 with a 7-day horizon relative to the newest audit day (the data spans a month)."""
    t = _tables(spark, sf)
    kept, deleted = AU.audit_retention(t["mapping_audit"], days=7)
    dq = t["quality_metrics"].join(deleted.select(F.col("id").alias("audit_id")), "audit_id", "left_semi")
    n_del, n_keep, n_q = deleted.select(F.count(F.lit(1))).scalar(), kept.select(F.count(F.lit(1))).scalar(), \
        dq.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n_del.alias("deleted"), n_keep.alias("kept"), n_q.alias("deleted_quality"))


@query("latency_percentiles", """SELECT mapper_type, count(*) AS n, round(avg(processing_time_ms), 6) AS mean_ms,
  round(quantile_cont(processing_time_ms, 0.5), 6) AS p50, round(quantile_cont(processing_time_ms, 0.9), 6) AS p90,
  round(quantile_cont(processing_time_ms, 0.95), 6) AS p95, round(quantile_cont(processing_time_ms, 0.99), 6) AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY mapper_type ORDER BY "timestamp" DESC, id) AS rn FROM mapping_audit)
WHERE rn <= 1000 GROUP BY mapper_type""")
def latency_percentiles(spark, sf):
    r = AU.latency_percentiles(_tables(spark, sf)["mapping_audit"], 1000)
    return r.select("mapper_type", "n", *[rnd(c).alias(c) for c in ["mean_ms", "p50", "p90", "p95", "p99"]])


@query("duplicate_rate", f"""WITH k AS (SELECT *, md5({K.request_key_text("coalesce(mapping_method, 'unknown')").replace('AS STRING', 'AS VARCHAR')}) AS request_key,
  coalesce(mapping_method, 'unknown') AS mapper_type FROM operations),
h AS (SELECT *, lag(ts) OVER (PARTITION BY request_key ORDER BY ts, request_id) AS prev FROM k)
SELECT mapper_type, count(*) AS requests, sum(CASE WHEN prev IS NOT NULL AND date_diff('second', prev, ts) <= 3600 THEN 1 ELSE 0 END)::BIGINT AS hits,
  round(avg(CASE WHEN prev IS NOT NULL AND date_diff('second', prev, ts) <= 3600 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate FROM h GROUP BY mapper_type""")
def duplicate_rate(spark, sf):
    ops = MV.operations(spark, sf).withColumn("mapper_type", F.coalesce("mapping_method", F.lit("unknown")))
    r = AU.duplicate_rate(ops, "mapper_type")
    return r.select("mapper_type", "requests", "hits", rnd("hit_rate", 9).alias("hit_rate"))
