"""Audit tables and their analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.ranking import global_row_number, numeric_bucket
from riskframe.operators.risk import INPUT_HASH_TEXT, request_key_text
from riskframe.sources.views import epoch_micros


def audit_tables(ops: DataFrame) -> dict[str, DataFrame]:
    """Normalise operations into the audit star (one scan, several projections).
    Absent results default to mapper 'unknown', prediction -1 and numbers 0; the status is
    'error' exactly when a message is present.  Child rows only where the data exists."""
    header = ops.select(
        F.col("audit_id").alias("id"), F.col("ts").alias("timestamp"), "session_id", "user_id",
        F.lit("feature_mapping").alias("operation_type"), F.sha2(F.expr(INPUT_HASH_TEXT), 256).alias("input_hash"),
        F.coalesce("mapping_method", F.lit("unknown")).alias("mapper_type"), "model_version",
        F.coalesce("processing_time_ms", F.lit(0.0)).alias("processing_time_ms"),
        F.coalesce("mapping_confidence", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("prediction", F.lit(-1)).alias("fraud_prediction"),
        F.coalesce("fraud_probability", F.lit(0.0)).alias("fraud_probability"),
        F.when(F.col("error_message").isNull(), "success").otherwise("error").alias("validation_status"),
        "error_message", F.to_date("ts").alias("dt"))
    details = ops.select("audit_id", "transaction_amount", "merchant_category", "hour_of_day", "day_of_week",
                         F.col("is_weekend").cast("int").alias("is_weekend"), "location_risk", "spending_pattern")
    quality = ops.filter("has_quality").select(
        "audit_id", (1 - F.col("fraud_probability") / 4).alias("correlation_preservation"),
        (0.9 - F.col("fraud_probability") / 5).alias("distribution_similarity"),
        F.lit(0.8).alias("prediction_consistency"), (F.col("fraud_probability") / 3).alias("mapping_uncertainty"),
        F.col("mapping_confidence").alias("overall_confidence"))
    out = {"mapping_audit": header, "input_details": details, "quality_metrics": quality}
    if "estimates" in ops.columns:
        out["mapping_results"] = ops.filter(F.col("estimates").isNotNull()).select(
            "audit_id", F.posexplode("estimates").alias("i", "estimated_value")).select(
            "audit_id", F.concat(F.lit("V"), (F.col("i") + 1).cast("string")).alias("pca_component"), "estimated_value",
            (F.col("estimated_value") - 0.5).alias("confidence_lower"), (F.col("estimated_value") + 0.5).alias("confidence_upper"))
    if "contributions" in ops.columns:
        out["feature_contributions"] = ops.filter(F.col("contributions").isNotNull()).select(
            "audit_id", F.explode("contributions").alias("feature_name", "contribution_value"))
    return out


def write_audit(tables: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """Persist the star: header partitioned by event date, children as plain parquet."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy("dt") if "dt" in df.columns else w).parquet(f"{root.rstrip('/')}/{name}")


def audit_jsonl(ops: DataFrame) -> DataFrame:
    """One nested JSON document per operation (input struct, result, error)."""
    doc = F.struct(
        F.col("audit_id"), F.col("ts").cast("string").alias("timestamp"), "session_id", "user_id",
        F.struct("transaction_amount", "merchant_category",
                 F.struct("hour_of_day", "day_of_week", "is_weekend", F.lit(False).alias("is_holiday")).alias("time_context"),
                 "location_risk", "spending_pattern").alias("user_input"),
        F.when(F.col("error_message").isNull(), F.struct("processing_time_ms", "mapping_confidence", "prediction",
                                                          "fraud_probability")).alias("mapping_result"),
        "error_message")
    return ops.select("audit_id", F.to_json(doc).alias("json"))


SUMMARY_COLS = ["audit_id", "timestamp", "operation_type", "mapper_type", "transaction_amount", "merchant_category",
                "confidence_score", "fraud_prediction", "fraud_probability", "processing_time_ms", "validation_status"]


def audit_summary(header: DataFrame, details: DataFrame) -> DataFrame:
    """The 11-column flat summary row."""
    return header.join(details, header.id == details.audit_id).select(*SUMMARY_COLS)


def audit_filter(header: DataFrame, start=None, end=None, mapper=None) -> DataFrame:
    """P10: optional conjunctive filters (pushed to the parquet scan when read from files)."""
    x = header
    if start is not None:
        x = x.filter(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        x = x.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    if mapper is not None:
        x = x.filter(F.col("mapper_type") == mapper)
    return x


def latest(header: DataFrame, n: int = 1000) -> DataFrame:
    """Newest first, limit n (TakeOrderedAndProject; id breaks ties)."""
    return header.orderBy(F.col("timestamp").desc(), F.col("id")).limit(n)


def audit_export(header: DataFrame, details: DataFrame, start, end, n: int = 10000) -> DataFrame:
    """Date-range filter, newest n, as the summary shape (write with ``export``)."""
    h = latest(audit_filter(header, start, end), n)
    return audit_summary(h, details)


#: Microseconds survive the text formats.
_TEXT_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def export(df: DataFrame, path: str, fmt: str) -> bool:
    """S06 / S08 sink: csv (header) or json; an unknown format raises; an empty result writes nothing and gives False."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported export format {fmt!r}")
    if df.isEmpty():
        return False
    df.write.mode("overwrite").options(**_TEXT_OPTIONS).format(fmt).save(path)
    return True


def exported(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    """The rows that ``export`` wrote."""
    return spark.read.schema(schema).options(**_TEXT_OPTIONS).format(fmt).load(path)


def audit_statistics(header: DataFrame) -> DataFrame:
    """Counts by mapper, by status, by prediction (excluding -1) and the total row with
    average confidence (3 dp), latency (2 dp) and success percentage (2 dp) — one
    GROUPING SETS aggregate over a single scan."""
    return header.sparkSession.sql("""
        SELECT * FROM (SELECT CASE WHEN grouping(mapper_type) = 0 THEN 'mapper' WHEN grouping(validation_status) = 0 THEN 'status'
                    WHEN grouping(pred) = 0 THEN 'prediction' ELSE 'total' END AS grouping_key,
               coalesce(mapper_type, validation_status, CAST(pred AS STRING)) AS grouping_value,
               count(1) AS count,
               CASE WHEN grouping_id() = 7 THEN round(avg(confidence_score), 3) END AS avg_confidence,
               CASE WHEN grouping_id() = 7 THEN round(avg(processing_time_ms), 2) END AS avg_latency_ms,
               CASE WHEN grouping_id() = 7 THEN round(sum(CASE WHEN validation_status = 'success' THEN 1 ELSE 0 END) * 100.0D
                    / greatest(count(1), 1), 2) END AS success_rate
        FROM (SELECT *, CASE WHEN fraud_prediction <> -1 THEN fraud_prediction END AS pred FROM {header})
        GROUP BY GROUPING SETS ((mapper_type), (validation_status), (pred), ()))
        WHERE NOT (grouping_key = 'prediction' AND grouping_value IS NULL)""", header=header)


def audit_retention(header: DataFrame, days: int = 90, now=None) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) header rows: older than midnight of ``now`` minus ``days`` are
    deleted.  Children follow with a left_semi (delete) / left_anti (keep) on the id."""
    ref = F.lit(now).cast("timestamp_ntz") if now is not None else header.select(F.max("timestamp")).scalar()
    cutoff = F.date_trunc("day", ref) - F.make_dt_interval(F.lit(days))
    old = F.col("timestamp") < cutoff
    return header.filter(~old), header.filter(old)


def latency_percentiles(header: DataFrame, n: int = 1000) -> DataFrame:
    """A10: mean, p50/p90/p95/p99 of the latest n response times per mapper.  The latest-n
    cut uses bucketed global ranks (no one-partition window per mapper); the percentile
    buffers then hold at most n values per mapper."""
    x = header.withColumn("_neg", -epoch_micros(F.col("timestamp")))
    r = global_row_number(x, [F.col("_neg"), F.col("id")], numeric_bucket(x, "_neg"), partition_by=["mapper_type"])
    last = r.filter(F.col("rn") <= n)
    return last.groupBy("mapper_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("processing_time_ms").alias("mean_ms"),
        *[F.percentile("processing_time_ms", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)])


def duplicate_rate(ops: DataFrame, mapper: str = "mapper_type", ttl_seconds: int = 3600) -> DataFrame:
    """Share of requests identical (H02 key) to an earlier one within the TTL."""
    k = ops.withColumn("request_key", F.md5(F.expr(request_key_text(mapper))))
    from pyspark.sql import Window
    prev = F.lag("ts").over(Window.partitionBy("request_key").orderBy("ts", "request_id"))
    hit = (F.timestamp_diff("SECOND", prev, F.col("ts")) <= ttl_seconds) & prev.isNotNull()
    return k.withColumn("hit", hit).groupBy(mapper).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"))
