"""Model registry, performance history and experiments as tables (G01-G12, W05, W07-W13,
D06-D11, U01, U02).  Event logs are folded to current state with aggregates (max_by /
min_by) rather than per-key loops; windows are partitioned by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: default degradation thresholds, and the manager's stricter set
DEFAULT_THRESHOLDS = {"accuracy": 0.95, "precision": 0.90, "recall": 0.85, "f1": 0.88, "auc": 0.90,
                      "drift": 0.1, "error_rate": 0.05}
MANAGER_THRESHOLDS = {"accuracy": 0.99, "precision": 0.95, "recall": 0.90, "f1": 0.92, "auc": 0.95,
                      "drift": 0.1, "error_rate": 0.01}
LOWER_IS_BETTER = ("drift", "error_rate")
#: What to do about a breached metric; an alert without any of these asks to watch the trend.
ACTIONS = {"accuracy": "review_training_data", "precision": "adjust_threshold", "recall": "study_missed_cases",
           "drift": "validate_input_data", "error_rate": "check_deployment"}
WATCH = "watch_trend"


def model_versions(reg: DataFrame) -> DataFrame:
    """G01 + W12: latest registration per version id (a repeated id replaces), first
    registration time as created_at, auto version '1.<earlier versions>', newest active,
    best f1 production."""
    v = reg.groupBy("version_id").agg(
        F.first("model_type").alias("model_type"), F.min("registered_at").alias("created_at"),
        F.max_by("accuracy", "registered_at").alias("accuracy"), F.max_by("f1", "registered_at").alias("f1"))
    w = Window.partitionBy("model_type")
    return v.withColumn("version_number", F.concat(F.lit("1."), (F.row_number().over(
        w.orderBy("created_at", "version_id")) - 1).cast("string"))) \
        .withColumn("is_active", F.row_number().over(w.orderBy(F.col("created_at").desc(), F.col("version_id").desc())) == 1) \
        .withColumn("is_production", F.row_number().over(w.orderBy(F.col("f1").desc(), "version_id")) == 1)


def degradation(perf: DataFrame, thresholds: dict = DEFAULT_THRESHOLDS, out: str = "reasons") -> DataFrame:
    """Degraded iff any metric is below (or drift / error rate above) its threshold;
    the list of reason codes."""
    conds = []
    for m, t in thresholds.items():
        c = F.col(m) > t if m in LOWER_IS_BETTER else F.col(m) < t
        conds.append(F.when(c, F.lit(f"{m}_{'above' if m in LOWER_IS_BETTER else 'below'}_threshold")))
    arr = F.filter(F.array(*conds), lambda x: x.isNotNull())
    return perf.withColumn(out, arr).withColumn("is_degraded", F.size(out) > 0)


def performance_alerts(perf: DataFrame, thresholds: dict = DEFAULT_THRESHOLDS) -> DataFrame:
    """Degraded rows only; severity by #reasons (>=4 critical, >=2 high, else medium);
    the action codes of the breached metrics; retrain flag from 3 reasons."""
    d = degradation(perf, thresholds).filter("is_degraded")
    n = F.size("reasons")
    breached = lambda m: F.col(m) > thresholds[m] if m in LOWER_IS_BETTER else F.col(m) < thresholds[m]
    codes = F.filter(F.array(*[F.when(breached(m), F.lit(a)) for m, a in ACTIONS.items() if m in thresholds]), lambda x: x.isNotNull())
    return d.withColumn("actions", F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(WATCH)))) \
        .withColumn("severity", F.when(n >= 4, "critical").when(n >= 2, "high").otherwise("medium")) \
        .withColumn("retrain", n >= 3)


def health_status(latest_perf: DataFrame) -> DataFrame:
    """None -> unknown; degraded -> unhealthy; f1 >= .95 excellent, >= .9 good, else fair."""
    d = degradation(latest_perf)
    h = (F.when(F.col("f1").isNull(), "unknown").when(F.col("is_degraded"), "unhealthy")
         .when(F.col("f1") >= 0.95, "excellent").when(F.col("f1") >= 0.9, "good").otherwise("fair"))
    return d.withColumn("health", h)


def latest_per_model(perf: DataFrame, model: str = "model_id", ts: str = "day", n: int = 1) -> DataFrame:
    """The newest n rows per model (window partitioned by model)."""
    w = Window.partitionBy(model).orderBy(F.col(ts).desc())
    return perf.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def performance_trend(perf: DataFrame, model: str = "model_id", ts: str = "day", window: int = 10) -> DataFrame:
    """Over the newest ``window`` rows, mean f1 of the newest 3 vs the oldest 3:
    > +.01 improving, < -.01 degrading, else stable; fewer than 2 rows: insufficient."""
    last = latest_per_model(perf, model, ts, window)
    w = Window.partitionBy(model).orderBy(F.col(ts).asc())
    x = last.withColumn("age_rank", F.row_number().over(w))
    g = x.groupBy(model).agg(F.count(F.lit(1)).alias("n"),
                             F.avg(F.when(F.col("recency") <= 3, F.col("f1"))).alias("recent_f1"),
                             F.avg(F.when(F.col("age_rank") <= 3, F.col("f1"))).alias("older_f1"))
    d = F.col("recent_f1") - F.col("older_f1")
    return g.withColumn("trend", F.when(F.col("n") < 2, "insufficient").when(d > 0.01, "improving")
                        .when(d < -0.01, "degrading").otherwise("stable"))


def model_status(models: DataFrame, versions: DataFrame, perf: DataFrame, model: str = "model_id", ts: str = "day") -> DataFrame:
    """One row per model: active version, latest metrics, trend, health and whether it may go to production.

    A model without versions or without metrics stays, with nulls, trend ``insufficient`` and health ``unknown``.
    """
    active = versions.where("is_active").groupBy(model).agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("active_version"))
    last = latest_per_model(perf, model, ts)
    out = models.select(model).distinct().join(active, model, "left").join(last.drop("recency"), model, "left") \
        .join(performance_trend(perf, model, ts).select(model, "trend"), model, "left")
    return health_status(out).withColumn("trend", F.coalesce("trend", F.lit("insufficient"))).withColumn("production_ready", F.coalesce(production_ready(), F.lit(False)))


def production_ready(thresholds: dict = DEFAULT_THRESHOLDS) -> Column:
    """All five quality metrics at or above their thresholds."""
    ok = F.lit(True)
    for m in ("accuracy", "precision", "recall", "f1", "auc"):
        ok = ok & (F.col(m) >= thresholds[m])
    return ok


def cascade_delete(gone: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows whose ``key`` is in ``gone``; rows with a null key stay.

    ``gone`` is not broadcast by hand: its measured size decides.
    """
    keys = gone.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}
