"""Reports, alerts and written results over finished evaluations and registries
(A07, D08, D11, G04, G10, M10, M11, S03, S09, S11, S12, X04, X06, X07, X09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import metrics as M

#: Alert limits of a mapper; mean AUC of a tier, best first, with the risk that goes with it.
MSE_LIMIT, CORRELATION_LIMIT = 0.5, 0.7
TIERS = [(0.9, "excellent", "low"), (0.8, "good", "medium"), (0.7, "fair", "medium_high")]
LOWEST_TIER = ("needs_improvement", "high")
#: From so many models on they count as diverse; a mean AUC from here on is a strength.
DIVERSE, STRONG = 5, 0.8
LOWER_IS_BETTER = ("loss", "error_rate", "drift_score")


def performance_summary(evaluations: DataFrame) -> DataFrame:
    """One row: number of models, mean and best AUC, map of the recall by model."""
    return evaluations.agg(F.count(F.lit(1)).alias("models"), F.avg("roc_auc").alias("mean_auc"), F.max("roc_auc").alias("best_auc"),
                           F.map_from_entries(F.collect_list(F.struct("model", "recall"))).alias("recall_by_model"))


def mapper_alerts(versions: DataFrame, champion: str = "is_production", mse: str = "mse", correlation: str = "avg_correlation") -> DataFrame:
    """A row per limit that a champion misses: error above 0.5 (medium), correlation below 0.7 (high).

    An absent figure raises no alert.
    """
    def alert(miss: Column, code: str, severity: str, value: str, limit: float) -> Column:
        return F.when(miss, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(value).cast("double").alias("value"),
                                     F.lit(limit).alias("limit")))
    alerts = F.array_compact(F.array(alert(F.col(mse) > MSE_LIMIT, "mse_above_limit", "medium", mse, MSE_LIMIT),
                                     alert(F.col(correlation) < CORRELATION_LIMIT, "correlation_below_limit", "high", correlation, CORRELATION_LIMIT)))
    return versions.where(champion).select("version_id", "model_type", F.explode(alerts).alias("a")).select("version_id", "model_type", "a.*")


def monitor_batch(scored: DataFrame, groups: list[str], latency: str, drift_cols: list[str]) -> DataFrame:
    """A history row per model and batch of scored rows (y, pred, p, latency in ms).

    Metrics and AUC (M09), error rate, latency a row, rows a second, shares of the three
    probability bands (below .3, below .7, up to 1), and the drift score without a baseline:
    mean of std / |mean| over ``drift_cols`` with a mean other than 0, halved, at most 1.
    """
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    cv = F.array_compact(F.array(*[F.when(F.avg(c) != 0, F.stddev_pop(c) / F.abs(F.avg(c))) for c in drift_cols]))
    rows = scored.groupBy(*groups).agg(
        F.avg(latency).alias("latency_ms"), F.try_divide(F.count(F.lit(1)) * 1000.0, F.sum(latency)).alias("throughput"),
        share((F.col("p") >= 0) & (F.col("p") < 0.3)).alias("band_low"), share((F.col("p") >= 0.3) & (F.col("p") < 0.7)).alias("band_medium"),
        share((F.col("p") >= 0.7) & (F.col("p") <= 1)).alias("band_high"), cv.alias("_cv"))
    mean = F.try_divide(F.aggregate("_cv", F.lit(0.0), lambda a, x: a + x), F.size("_cv"))
    rows = rows.withColumn("drift_score", F.coalesce(F.least(mean / 2, F.lit(1.0)), F.lit(0.0))).drop("_cv")
    ev = M.evaluation_record(scored, groups=groups).withColumn("error_rate", 1 - F.col("accuracy"))
    return ev.join(rows, groups)


def deployment_outcomes(deployments: DataFrame, healthy: Column, model: str = "model_type", order: tuple = ("registered_at", "version_id")) -> DataFrame:
    """Every deployment of an event log as champion, in its order per model.

    A healthy one succeeds and stays.  An unhealthy one gives way to the champion before
    it (rolled back, a success), or, where there was none, fails and stays the champion;
    so the champion before a row is the last healthy version, else the model's first.
    """
    w = Window.partitionBy(model).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    x = deployments.withColumn("is_healthy", F.coalesce(healthy, F.lit(False)))
    x = x.withColumn("previous_champion", F.coalesce(F.last(F.when(F.col("is_healthy"), F.col("version_id")), ignorenulls=True).over(past),
                                                     F.first("version_id").over(past)))
    back = ~F.col("is_healthy") & F.col("previous_champion").isNotNull()
    return x.select("version_id", model, "is_healthy", "previous_champion", back.alias("rolled_back"), (F.col("is_healthy") | back).alias("success"),
                    F.when(back, F.col("previous_champion")).otherwise(F.col("version_id")).alias("champion_after"))


def batch_outcome(outcomes: DataFrame, model: str = "model_type") -> DataFrame:
    """Per model, counts of a batch of deployments."""
    n = lambda c: F.count_if(c)
    return outcomes.groupBy(model).agg(F.count(F.lit(1)).alias("total"), n(F.col("success")).alias("successful"), n(~F.col("success")).alias("failed"),
                                       n(F.col("rolled_back")).alias("rolled_back"))


def experiment_comparison(named: DataFrame, experiments: DataFrame) -> DataFrame:
    """Values of parameters and metrics of the chosen ``experiments``, the best of every metric marked.

    ``named`` is (experiment_id, kind, name, value).  Of equal values the smaller id is the
    best.  With fewer than two experiments there is nothing to compare: no rows.
    """
    n = experiments.select(F.countDistinct("experiment_id")).scalar()
    x = named.join(experiments.select("experiment_id").distinct(), "experiment_id", "left_semi").withColumn("n_experiments", n).where("n_experiments >= 2")
    rank = F.when(F.lower("name").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    best = x.where("kind = 'metric' AND value IS NOT NULL").groupBy("name").agg(F.min_by("experiment_id", F.struct(rank, "experiment_id")).alias("best"))
    return x.join(best, "name", "left").select("kind", "name", "experiment_id", "value", "n_experiments",
                                               F.coalesce((F.col("kind") == "metric") & (F.col("experiment_id") == F.col("best")), F.lit(False)).alias("is_best"))


def dashboard_frame(evaluations: DataFrame, cv: DataFrame) -> DataFrame:
    """A row per model with its metrics, matrix, samples and cross-validated AUC; the largest AUC is marked.

    ``cv`` is M08's (model, metric, test_mean, test_std).  Of equal AUCs the first name is best.
    """
    auc = cv.where("metric = 'roc_auc'").select("model", F.col("test_mean").alias("cv_auc_mean"), F.col("test_std").alias("cv_auc_std"))
    best = evaluations.select(F.min_by("model", F.struct(-F.col("roc_auc"), "model"))).scalar()
    return evaluations.join(auc, "model", "left").select("model", "roc_auc", "average_precision", "precision", "recall", "f1", "cv_auc_mean", "cv_auc_std",
                                                         F.col("n").alias("samples"), "tn", "fp", "fn", "tp", (F.col("model") == best).alias("is_best"))


def insight_tier(evaluations: DataFrame) -> DataFrame:
    """Tier and risk by the mean AUC, codes of strengths and of advice; one row, none without models."""
    x = evaluations.agg(F.count(F.lit(1)).alias("models"), F.avg(F.coalesce("roc_auc", F.lit(0.0))).alias("mean_auc")).where("models > 0")
    tier, risk = F.lit(LOWEST_TIER[0]), F.lit(LOWEST_TIER[1])
    for limit, t, r in reversed(TIERS):
        tier, risk = F.when(F.col("mean_auc") >= limit, t).otherwise(tier), F.when(F.col("mean_auc") >= limit, r).otherwise(risk)
    strengths = F.array_compact(F.array(F.when(F.col("models") >= DIVERSE, "model_diversity"), F.when(F.col("mean_auc") >= STRONG, "predictive_performance")))
    advice = F.array_compact(F.array(F.when(F.col("mean_auc") < STRONG, "improve_features"), F.lit("monitor_continuously"), F.lit("retrain_on_schedule")))
    return x.select("models", "mean_auc", tier.alias("tier"), risk.alias("risk"), strengths.alias("strengths"), advice.alias("advice"))


def simple_attribution(df: DataFrame, features: list[str], importance: dict[str, float] | None = None, id_col: str = "event_id") -> DataFrame:
    """(id_col, feature, contribution, base): importance times value, base .5; without importances a tenth of the value."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(0.1 if importance is None else importance.get(c, 0.0)) * F.col(c)).alias("contribution"))
                     for c in features])
    return df.select(id_col, F.explode(rows).alias("a")).select(id_col, "a.*", F.lit(0.5).alias("base"))


def compare_explainers(df: DataFrame, features: list[str], first: dict[str, Column], second: dict[str, Column], id_col: str = "event_id") -> DataFrame:
    """(id_col, feature, first, second, first_rank, second_rank, agreement), two explanations of every row side by side.

    Ranks go by absolute value (six places, ties by name); ``agreement`` is their rank
    correlation over the row's features.  Row-local: both orders are sorted arrays, each sorted once per row.
    """
    n = len(features)
    both = F.array(*[F.struct(F.lit(f).alias("feature"), first[f].alias("first"), second[f].alias("second")) for f in features])

    def ranks(side: str) -> Column:
        """Every feature's rank, in the order of ``features``.  No lambda may refer to a sorted array: it would be sorted again for every element."""
        keys = F.transform("_b", lambda e, i: F.struct((-F.round(F.abs(e[side]), 6)).alias("k"), e["feature"].alias("feature"), i.alias("at")))
        placed = F.transform(F.sort_array(keys), lambda e, i: F.struct(e["at"].alias("at"), (i + 1).cast("long").alias("rank")))
        return F.transform(F.sort_array(placed), lambda e: e["rank"])
    x = df.select(id_col, both.alias("_b")).select(id_col, F.arrays_zip("_b", ranks("first").alias("_1"), ranks("second").alias("_2")).alias("_r"))
    apart = F.aggregate("_r", F.lit(0).cast("long"), lambda a, e: a + (e["_1"] - e["_2"]) * (e["_1"] - e["_2"]))
    agreement = 1 - F.lit(6.0) * apart / F.lit(float(n * (n * n - 1))) if n > 1 else F.lit(1.0)
    # the outer form: a plain explode infers a filter on the array's size, which goes below the ranks and computes them a second time
    return x.select(id_col, "_r", agreement.alias("agreement")).select(id_col, "agreement", F.explode_outer("_r").alias("r")) \
        .select(id_col, "r._b.*", F.col("r._1").alias("first_rank"), F.col("r._2").alias("second_rank"), "agreement")


def importance_comparison(importances: DataFrame, models: list[str], n: int = 15) -> DataFrame:
    """The ``n`` features of largest mean importance, a column per model (absent: 0); ties by name.

    ``importances`` is (model, feature, importance); signs are left out.
    """
    p = importances.groupBy("feature").pivot("model", models).agg(F.max(F.abs("importance"))).na.fill(0.0, models)
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    return p.withColumn("mean_importance", mean).withColumn("_k", F.round("mean_importance", 6)) \
        .orderBy(F.desc("_k"), "feature").limit(n).drop("_k")


def write_split(split: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The parts of a split in folders of their own, with a header and no row numbers where ``fmt`` is csv."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    w = split.write.partitionBy("split").mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def save_stats(frames: dict[str, DataFrame], path: str) -> None:
    """Statistics tables by name under one folder; older ones of the same name are replaced."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_stats(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """The tables that ``save_stats`` wrote."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items()}


_REPORT = {"model": "model", "auc": "roc_auc", "precision": "precision", "recall": "recall", "f1": "f1", "accuracy": "accuracy"}
REPORT_SCHEMA = "model string, auc double, precision double, recall double, f1 double, accuracy double"


def export_report(evaluations: DataFrame, path: str) -> None:
    """The models' metrics as JSON lines and as CSV with a header; one file each, since there is a row per model."""
    rows = evaluations.select(*[(F.col(c) if n == "model" else rnd(c, 9)).alias(n) for n, c in _REPORT.items()]).orderBy("model").coalesce(1)
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def append_assessment(report: DataFrame, assessed_at: Column, path: str) -> None:
    """The report as one nested value with its time, appended to the table at ``path``."""
    report.select(assessed_at.alias("assessed_at"), F.struct(*report.columns).alias("report")).write.mode("append").parquet(path)
