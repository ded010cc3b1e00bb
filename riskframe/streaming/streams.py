"""Structured Streaming versions of the serving-side operators (ST01, ST04, ST06, ST08, ST09).

Each stream reads the events files with a fixed schema, derives the request / score
columns row by row (no join needed), and runs the same expressions as the batch
operators.  Checkpoints live under the cluster's ``spark.checkpoint.dir``.  The catalog
entries run them with ``availableNow`` into files in that shared folder and return those as
a batch frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.dims import LOCATIONS, MERCHANTS, SPENDING, enum_at
from riskframe.operators.abtest import ab_assignment
from riskframe.session import checkpoint_dir, prepare

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

MAPPERS = ["random_forest", "xgboost", "ensemble"]


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    prepare(spark)
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    # the file source watches folders: a table that is a single file is picked out of its folder
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/"))


def request_columns(ev: DataFrame) -> DataFrame:
    """Row-wise request + score + operation fields of an event (same rules as the views)."""
    eid = F.col("event_id")
    amount = F.col("value") * F.pow(1 + eid % 7, 3) - 5
    cls = ((F.col("event_type") == "error") & (F.col("value") >= 100)).cast("int")
    p = (eid * 7919) % 1000 / F.lit(2000.0) + F.lit(0.3) * cls
    ok = amount > 0
    return ev.select(
        eid.alias("request_id"), "ts", "user_id", amount.alias("transaction_amount"),
        enum_at(eid % 10, MERCHANTS).alias("merchant_category"),
        enum_at(F.col("user_id") % 4, LOCATIONS).alias("location_risk"),
        enum_at(F.floor(eid / 10) % 4, SPENDING).alias("spending_pattern"),
        F.coalesce(F.when(ok, enum_at(eid % 3, MAPPERS)), F.lit("unknown")).alias("mapper_type"),
        F.when(ok, F.col("value")).alias("latency_ms"), F.when(ok, 1 - p / 2).alias("confidence"),
        (~ok).alias("is_error"))


def stream_metrics(events: DataFrame, window: str = "1 hour", slide: str | None = None,
                   watermark: str = "10 minutes") -> DataFrame:
    """ST04: per event-time window and mapper: count, error rate, mean latency and
    confidence; rows later than the watermark are dropped."""
    r = request_columns(events).withColumn("event_time", F.col("ts").cast("timestamp")) \
        .withWatermark("event_time", watermark)
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return r.groupBy(w.alias("w"), "mapper_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.avg("confidence").alias("mean_confidence"))


def stream_history(events: DataFrame) -> DataFrame:
    """ST06: running count / mean confidence per (merchant, location, spending) pattern."""
    r = request_columns(events).filter(~F.col("is_error"))
    return r.groupBy("merchant_category", "location_risk", "spending_pattern").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))


def stream_ab(events: DataFrame, split: float = 0.5) -> DataFrame:
    """ST09: stateless A/B arm of live traffic (G06 on a stream)."""
    return ab_assignment(events.select("event_id", "user_id"), "user_id", True, split)


def stream_validate(events: DataFrame) -> DataFrame:
    """ST01: validation codes on arriving requests, built by the batch view's own columns;
    ``quarantined`` marks the requests that have any."""
    from riskframe.operators.rules import ALL_ERRORS
    from riskframe.sources.views import request_columns as batch_columns
    return events.select(*batch_columns()).withColumn("errors", F.expr(ALL_ERRORS)) \
        .withColumn("quarantined", F.col("errors").isNotNull())


def run_to_table(df: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Drive a streaming frame to completion (availableNow) into files under
    spark.checkpoint.dir and read them back; no row passes the driver.

    Append mode uses the file sink.  In complete mode, for states of bounded size, every
    batch replaces the whole result in a folder of its own and the last one is read.
    """
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name or uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")
    seen: list[int] = []

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{batch_id}")
        seen.append(batch_id)
    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out/{max(seen)}") if seen else spark.createDataFrame([], df.schema)


def run_audit(ops: DataFrame, root: str) -> None:
    """ST08: drive a stream of operations into the audit tables under ``root``, each batch once."""
    ops.writeStream.option("checkpointLocation", f"{root.rstrip('/')}/state").trigger(availableNow=True) \
        .foreachBatch(lambda batch, batch_id: audit_sink(batch, batch_id, f"{root.rstrip('/')}/audit")).start().awaitTermination()


def audit_sink(batch: DataFrame, batch_id: int, root: str) -> None:
    """ST08: foreachBatch writer appending one batch of operations to the audit tables; the
    batch id makes the write idempotent (a replayed batch overwrites its own folder)."""
    from riskframe.operators.audit import audit_tables
    batch.persist()
    for name, t in audit_tables(batch).items():
        t.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/batch_id={batch_id}")
    batch.unpersist()
