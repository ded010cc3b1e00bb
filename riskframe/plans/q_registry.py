"""Catalog: registry, performance history, experiments (G01-G03, G05, G08-G12, W05, W07-W13,
D06, D07, D09, D10, U01, U02, A13)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import registry as G
from riskframe.plans.catalog import query
from riskframe.sources import metadata_views as MV

_PERF = ["accuracy", "precision", "recall", "f1", "auc", "drift", "error_rate"]


def _last_row() -> Column:
    """Orders registrations of one version without ties."""
    return F.struct("registered_at", "accuracy", "f1")


def _by(value: str) -> Column:
    """Orders versions by a value; of equal ones the larger id is last."""
    return F.struct(value, "version_id")


@query("register_versions", """SELECT version_id, any_value(model_type) AS model_type, max(registered_at) AS registered_at,
  arg_max(accuracy, (registered_at, accuracy, f1)) AS accuracy, arg_max(f1, (registered_at, accuracy, f1)) AS f1
  FROM registrations GROUP BY version_id""")
def register_versions(spark, sf):
    """Append-only registrations; the latest row per version id wins (max_by fold)."""
    r = MV.registrations(spark, sf)
    return r.groupBy("version_id").agg(F.first("model_type").alias("model_type"), F.max("registered_at").alias("registered_at"),
                                       F.max_by("accuracy", _last_row()).alias("accuracy"), F.max_by("f1", _last_row()).alias("f1"))


@query("active_versions", "SELECT model_type, arg_max(version_id, (registered_at, version_id)) AS active_version FROM registrations GROUP BY model_type")
def active_versions(spark, sf):
    """After all activations (each registration activates), one active version per model."""
    r = MV.registrations(spark, sf)
    return r.groupBy("model_type").agg(F.max_by("version_id", _by("registered_at")).alias("active_version"))


@query("champions", """WITH p AS (SELECT model_type, version_id, registered_at,
  lag(version_id) OVER (PARTITION BY model_type ORDER BY registered_at, version_id) AS previous FROM registrations WHERE accuracy >= 0.5)
SELECT model_type, arg_max(version_id, (registered_at, version_id)) AS champion, arg_max(previous, (registered_at, version_id)) AS demoted FROM p GROUP BY model_type""")
def champions(spark, sf):
    """Promotions (registrations with accuracy >= .5) demote the previous champion of the
    same type: the champion is the last promotion, the demoted one its predecessor."""
    r = MV.registrations(spark, sf).filter(F.col("accuracy") >= 0.5)
    p = r.withColumn("previous", F.lag("version_id").over(Window.partitionBy("model_type").orderBy("registered_at", "version_id")))
    return p.groupBy("model_type").agg(F.max_by("version_id", _by("registered_at")).alias("champion"),
                                       F.max_by("previous", _by("registered_at")).alias("demoted"))


_MV_COLS = "version_id, model_type, created_at, accuracy, f1, version_number, is_active, is_production"


@query("auto_version", f"SELECT {_MV_COLS} FROM model_versions")
def auto_version(spark, sf):
    """W12 (+ G01 fold): version number '1.<count of earlier versions>' per model type."""
    return MV.model_versions(spark, sf).select(*[c.strip() for c in _MV_COLS.split(",")])


@query("version_history", """SELECT version_id, model_type,
  CAST(row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, version_id) AS INTEGER) AS position FROM model_versions""")
def version_history(spark, sf):
    """Versions newest first per model."""
    v = MV.model_versions(spark, sf)
    return v.select("version_id", "model_type", F.row_number().over(
        Window.partitionBy("model_type").orderBy(F.col("created_at").desc(), "version_id")).cast("int").alias("position"))


@query("rollback_target", """SELECT a.model_type, arg_max(v.version_id, (v.created_at, v.version_id)) AS rollback_version
FROM model_versions a JOIN model_versions v ON a.model_type = v.model_type AND v.created_at < a.created_at
WHERE a.is_active GROUP BY a.model_type""")
def rollback_target(spark, sf):
    """Most recent version created before the active one (no row when none)."""
    v = MV.model_versions(spark, sf)
    act = v.filter("is_active").select("model_type", F.col("created_at").alias("active_at"))
    c = v.join(act, "model_type").filter(F.col("created_at") < F.col("active_at"))
    return c.groupBy("model_type").agg(F.max_by("version_id", _by("created_at")).alias("rollback_version"))


@query("version_retention", """WITH v AS (SELECT *, is_active OR is_production AS protected,
  count(*) OVER (PARTITION BY model_type) AS total,
  count(*) FILTER (WHERE is_active OR is_production) OVER (PARTITION BY model_type) AS n_protected FROM model_versions),
r AS (SELECT *, row_number() OVER (PARTITION BY model_type, protected ORDER BY created_at DESC, version_id) AS rk FROM v)
SELECT version_id, model_type, (total <= 5 OR protected OR rk <= greatest(5 - n_protected, 0)) AS keep FROM r""")
def version_retention(spark, sf):
    """Keep active/production versions, then the newest others up to keep_count = 5."""
    v = MV.model_versions(spark, sf).withColumn("protected", F.col("is_active") | F.col("is_production"))
    w = Window.partitionBy("model_type")
    v = v.withColumn("total", F.count(F.lit(1)).over(w)).withColumn(
        "n_protected", F.sum(F.col("protected").cast("int")).over(w))
    v = v.withColumn("rk", F.row_number().over(Window.partitionBy("model_type", "protected")
                                               .orderBy(F.col("created_at").desc(), "version_id")))
    keep = (F.col("total") <= 5) | F.col("protected") | (F.col("rk") <= F.greatest(5 - F.col("n_protected"), F.lit(0)))
    return v.select("version_id", "model_type", keep.alias("keep"))


_COMPARED = ("accuracy", "f1")


@query("version_comparison", " UNION ALL ".join(f"""SELECT model_type, '{m}' AS metric, version_id, round({m}, 9) AS value,
  count(*) OVER (PARTITION BY model_type) AS versions,
  version_id = first_value(version_id) OVER (PARTITION BY model_type ORDER BY {m} DESC, version_id DESC) AS is_best FROM model_versions""" for m in _COMPARED))
def version_comparison(spark, sf):
    """Every version of a model with its metrics; the best one of each metric is marked, ties go to the larger id."""
    v = MV.model_versions(spark, sf)
    best = v.groupBy("model_type").agg(F.count(F.lit(1)).alias("versions"), *[F.max_by("version_id", _by(m)).alias(f"best_{m}") for m in _COMPARED])
    values = F.array(*[F.struct(F.lit(m).alias("metric"), rnd(m, 9).alias("value"), F.col(f"best_{m}").alias("best")) for m in _COMPARED])
    return v.join(best, "model_type").select("model_type", "version_id", "versions", F.explode(values).alias("x")) \
        .select("model_type", "x.metric", "version_id", "x.value", "versions", (F.col("version_id") == F.col("x.best")).alias("is_best"))


@query("deployment_status", """SELECT model_type, count(*) AS versions,
  arg_max(version_id, (created_at, version_id)) FILTER (WHERE is_active) AS active,
  arg_max(version_id, (created_at, version_id)) FILTER (WHERE is_production) AS production FROM model_versions GROUP BY model_type""")
def deployment_status(spark, sf):
    """Per model type: number of versions, active and production version (the newest that has the flag, null if none has)."""
    v = MV.model_versions(spark, sf)
    newest = lambda flag: F.max_by("version_id", F.when(F.col(flag), _by("created_at")))
    return v.groupBy("model_type").agg(F.count(F.lit(1)).alias("versions"), F.when(F.max("is_active"), newest("is_active")).alias("active"),
                                       F.when(F.max("is_production"), newest("is_production")).alias("production"))


def _reasons_sql(th):
    return "NULLIF(concat_ws(',', " + ", ".join(
        f"CASE WHEN {m} {'>' if m in G.LOWER_IS_BETTER else '<'} {t} THEN '{m}_{'above' if m in G.LOWER_IS_BETTER else 'below'}_threshold' END"
        for m, t in th.items()) + "), '')"


@query("degradation", f"""SELECT model_id, day, {_reasons_sql(G.DEFAULT_THRESHOLDS)} AS reasons,
  {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NOT NULL AS is_degraded,
  {_reasons_sql(G.MANAGER_THRESHOLDS)} IS NOT NULL AS degraded_strict FROM performance_history""")
def degradation(spark, sf):
    """Reasons under the default thresholds, and the manager's stricter set."""
    p = MV.performance_history(spark, sf)
    d = G.degradation(p, G.DEFAULT_THRESHOLDS)
    d = G.degradation(d, G.MANAGER_THRESHOLDS, "strict_reasons")
    return d.select("model_id", "day", F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"),
                    (F.size("reasons") > 0).alias("is_degraded"), (F.size("strict_reasons") > 0).alias("degraded_strict"))


def _actions_sql(th):
    codes = ", ".join(f"CASE WHEN {m} {'>' if m in G.LOWER_IS_BETTER else '<'} {th[m]} THEN '{a}' END" for m, a in G.ACTIONS.items())
    return f"coalesce(nullif(concat_ws(',', {codes}), ''), '{G.WATCH}')"


@query("performance_alerts", f"""SELECT model_id, day, CASE WHEN n >= 4 THEN 'critical' WHEN n >= 2 THEN 'high' ELSE 'medium' END AS severity,
  n >= 3 AS retrain, CAST(n AS INTEGER) AS n_reasons, reasons, actions FROM (
  SELECT model_id, day, {_reasons_sql(G.DEFAULT_THRESHOLDS)} AS reasons, len(string_split({_reasons_sql(G.DEFAULT_THRESHOLDS)}, ',')) AS n,
  {_actions_sql(G.DEFAULT_THRESHOLDS)} AS actions FROM performance_history
  WHERE {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NOT NULL)""")
def performance_alerts(spark, sf):
    a = G.performance_alerts(MV.performance_history(spark, sf))
    return a.select("model_id", "day", "severity", "retrain", F.size("reasons").cast("int").alias("n_reasons"),
                    F.array_join("reasons", ",").alias("reasons"), F.array_join("actions", ",").alias("actions"))


_LATEST = "lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day DESC) AS recency FROM performance_history) WHERE recency = 1)"


@query("health_status", f"""WITH {_LATEST} SELECT model_id, CASE WHEN f1 IS NULL THEN 'unknown'
  WHEN {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NOT NULL THEN 'unhealthy' WHEN f1 >= 0.95 THEN 'excellent' WHEN f1 >= 0.9 THEN 'good'
  ELSE 'fair' END AS health FROM lp""")
def health_status(spark, sf):
    lp = G.latest_per_model(MV.performance_history(spark, sf))
    return G.health_status(lp).select("model_id", "health")


@query("production_gate", f"""WITH {_LATEST} SELECT model_id, (accuracy >= 0.95 AND precision >= 0.90 AND recall >= 0.85
  AND f1 >= 0.88 AND auc >= 0.90) AS production_ready FROM lp""")
def production_gate(spark, sf):
    """All five metrics at or above the thresholds (latest metrics per model)."""
    lp = G.latest_per_model(MV.performance_history(spark, sf))
    return lp.select("model_id", G.production_ready().alias("production_ready"))


@query("performance_history", """SELECT model_id, day, round(f1, 9) AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day DESC) AS recency FROM performance_history) WHERE recency <= 100""")
def performance_history_q(spark, sf):
    """Latest 100 metric rows per model."""
    lp = G.latest_per_model(MV.performance_history(spark, sf), n=100)
    return lp.select("model_id", "day", rnd("f1", 9).alias("f1"))


@query("trim_history", """SELECT model_id, day FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day DESC) AS recency
  FROM performance_history) WHERE recency <= 10""")
def trim_history(spark, sf):
    """Keep the last N (10) events per model."""
    return G.latest_per_model(MV.performance_history(spark, sf), n=10).select("model_id", "day")


@query("performance_trend", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day DESC) AS recency
  FROM performance_history) WHERE recency <= 10),
x AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day) AS age_rank FROM l),
g AS (SELECT model_id, count(*) AS n, avg(f1) FILTER (WHERE recency <= 3) AS r, avg(f1) FILTER (WHERE age_rank <= 3) AS o FROM x GROUP BY model_id)
SELECT model_id, n, round(r, 9) AS recent_f1, round(o, 9) AS older_f1, CASE WHEN n < 2 THEN 'insufficient' WHEN r - o > 0.01 THEN 'improving'
  WHEN r - o < -0.01 THEN 'degrading' ELSE 'stable' END AS trend FROM g""")
def performance_trend(spark, sf):
    t = G.performance_trend(MV.performance_history(spark, sf))
    return t.select("model_id", "n", rnd("recent_f1", 9).alias("recent_f1"), rnd("older_f1", 9).alias("older_f1"), "trend")


_TREND_SQL = """l10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day DESC) AS recency FROM performance_history) WHERE recency <= 10),
aged AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY day) AS age_rank FROM l10),
tr AS (SELECT model_id, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN avg(f1) FILTER (WHERE recency <= 3) - avg(f1) FILTER (WHERE age_rank <= 3) > 0.01 THEN 'improving'
  WHEN avg(f1) FILTER (WHERE recency <= 3) - avg(f1) FILTER (WHERE age_rank <= 3) < -0.01 THEN 'degrading' ELSE 'stable' END AS trend FROM aged GROUP BY model_id)"""
_NAMED_MODELS_SQL = """ids AS (SELECT model_id, row_number() OVER (ORDER BY model_id) AS place FROM (SELECT DISTINCT model_id FROM performance_history)),
types AS (SELECT model_type, row_number() OVER (ORDER BY model_type) AS place FROM (SELECT DISTINCT model_type FROM model_versions)),
named AS (SELECT coalesce(model_id, model_type) AS model_id, model_type FROM ids FULL JOIN types USING (place))"""


def _models(spark, sf):
    """(model_id, versions with model_id, history): stand-in for one registry.  The n-th model with a history has the n-th
    type's versions; what is left over on either side has the other table empty.  Both lists are names, not rows of the data."""
    history, versions = MV.performance_history(spark, sf), MV.model_versions(spark, sf)
    place = lambda df, c: df.select(c).distinct().withColumn("place", F.row_number().over(Window.orderBy(c)))
    named = place(history, "model_id").join(place(versions, "model_type"), "place", "full") \
        .select(F.coalesce("model_id", "model_type").alias("model_id"), "model_type")
    return named.select("model_id"), versions.join(named, "model_type"), history


@query("model_status", f"""WITH {_LATEST}, {_TREND_SQL}, {_NAMED_MODELS_SQL},
av AS (SELECT n.model_id, arg_max(v.version_id, (v.created_at, v.version_id)) AS active_version FROM named n JOIN model_versions v USING (model_type) WHERE v.is_active GROUP BY 1)
SELECT n.model_id, av.active_version, lp.day AS measured_on, round(lp.accuracy, 9) AS accuracy, round(lp.f1, 9) AS f1, coalesce(tr.trend, 'insufficient') AS trend,
  CASE WHEN lp.f1 IS NULL THEN 'unknown' WHEN {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NOT NULL THEN 'unhealthy' WHEN lp.f1 >= 0.95 THEN 'excellent'
    WHEN lp.f1 >= 0.9 THEN 'good' ELSE 'fair' END AS health,
  coalesce(accuracy >= 0.95 AND precision >= 0.90 AND recall >= 0.85 AND f1 >= 0.88 AND auc >= 0.90, false) AS production_ready
FROM named n LEFT JOIN av ON n.model_id = av.model_id LEFT JOIN lp ON n.model_id = lp.model_id LEFT JOIN tr ON n.model_id = tr.model_id""")
def model_status(spark, sf):
    """Every model with its active version, latest metrics, trend and health."""
    s = G.model_status(*_models(spark, sf))
    return s.select("model_id", "active_version", F.col("day").alias("measured_on"), rnd("accuracy", 9).alias("accuracy"), rnd("f1", 9).alias("f1"),
                    "trend", "health", "production_ready")


@query("model_status_counts", f"""WITH {_LATEST} SELECT count(*) AS models,
  count(*) FILTER (WHERE {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NULL) AS healthy,
  count(*) FILTER (WHERE {_reasons_sql(G.DEFAULT_THRESHOLDS)} IS NOT NULL) AS unhealthy,
  count(*) FILTER (WHERE accuracy >= 0.95 AND precision >= 0.90 AND recall >= 0.85 AND f1 >= 0.88 AND auc >= 0.90) AS production FROM lp""")
def model_status_counts(spark, sf):
    """Counts of the dashboard: models, healthy and unhealthy ones, and those fit for production."""
    lp = G.health_status(G.latest_per_model(MV.performance_history(spark, sf)))
    t = G.DEFAULT_THRESHOLDS
    ready = (F.col("accuracy") >= t["accuracy"]) & (F.col("precision") >= t["precision"]) & (F.col("recall") >= t["recall"]) \
        & (F.col("f1") >= t["f1"]) & (F.col("auc") >= t["auc"])
    return lp.agg(F.count(F.lit(1)).alias("models"), F.sum((~F.col("is_degraded")).cast("long")).alias("healthy"),
                  F.sum(F.col("is_degraded").cast("long")).alias("unhealthy"), F.sum(ready.cast("long")).alias("production"))


@query("cascade_delete", f"""WITH {_LATEST}, {_NAMED_MODELS_SQL},
bad AS (SELECT model_id FROM lp WHERE {_reasons_sql(G.MANAGER_THRESHOLDS)} IS NOT NULL AND accuracy < (SELECT max(accuracy) FROM lp)),
bad_e AS (SELECT experiment_id FROM experiments WHERE status <> 'completed')
SELECT 'models' AS table_name, model_id AS key, count(*) AS n_rows FROM named WHERE model_id NOT IN (SELECT model_id FROM bad) GROUP BY 2
UNION ALL SELECT 'versions', n.model_id, count(*) FROM model_versions v JOIN named n USING (model_type) WHERE n.model_id NOT IN (SELECT model_id FROM bad) GROUP BY 2
UNION ALL SELECT 'history', model_id, count(*) FROM performance_history WHERE model_id NOT IN (SELECT model_id FROM bad) GROUP BY 2
UNION ALL SELECT 'experiments', experiment_id, count(*) FROM experiments WHERE experiment_id NOT IN (SELECT experiment_id FROM bad_e) GROUP BY 2
UNION ALL SELECT 'metrics', experiment_id, count(*) FROM experiment_metrics WHERE experiment_id NOT IN (SELECT experiment_id FROM bad_e) GROUP BY 2""")
def cascade_delete(spark, sf):
    """Degraded models (but the most accurate one) and unfinished experiments go with their dependent rows; rows left per table and key."""
    models, versions, history = _models(spark, sf)
    last = G.degradation(G.latest_per_model(history), G.MANAGER_THRESHOLDS)
    bad = last.withColumn("best", last.select(F.max("accuracy")).scalar()).where("is_degraded AND accuracy < best")
    left = G.cascade_delete(bad, "model_id", {"models": models, "versions": versions, "history": history})
    e = MV.experiments(spark, sf)
    left |= G.cascade_delete(e.where("status <> 'completed'"), "experiment_id", {"experiments": e, "metrics": MV.experiment_metrics(spark, sf)})
    out = None
    for name, t in left.items():
        key = "model_id" if "model_id" in t.columns else "experiment_id"
        part = t.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "key", "n_rows")
        out = part if out is None else out.union(part)
    return out


@query("metric_history", """SELECT experiment_id, metric, count(*) AS steps, round(arg_max(value, step), 9) AS latest_value
FROM experiment_metrics GROUP BY experiment_id, metric""")
def metric_history(spark, sf):
    """Stepped metrics; the latest value per metric (max_by over step)."""
    m = MV.experiment_metrics(spark, sf)
    return m.groupBy("experiment_id", "metric").agg(F.count(F.lit(1)).alias("steps"),
                                                    rnd(F.max_by("value", "step"), 9).alias("latest_value"))


@query("experiment_list", "SELECT experiment_id, status, created_at FROM experiments WHERE status = 'completed' ORDER BY created_at DESC, experiment_id LIMIT 50")
def experiment_list(spark, sf):
    """Filter by status, newest 50."""
    e = MV.experiments(spark, sf)
    return e.filter(F.col("status") == "completed").orderBy(F.col("created_at").desc(), "experiment_id").limit(50) \
        .select("experiment_id", "status", "created_at")


_LATEST_M = "lm AS (SELECT experiment_id, metric, arg_max(value, step) AS value FROM experiment_metrics GROUP BY ALL)"


_NAMED_SQL = f"""{_LATEST_M}, named AS (SELECT experiment_id, 'param' AS kind, substr(name, 7) AS name, value
  FROM (UNPIVOT (SELECT * EXCLUDE (status, created_at) FROM experiments) ON COLUMNS(* EXCLUDE (experiment_id)) INTO NAME name VALUE value)
  UNION ALL SELECT experiment_id, 'metric', metric, value FROM lm)"""


def _named_values(spark, sf):
    """(experiment_id, kind, name, value): every parameter column and the latest value of every metric."""
    e = MV.experiments(spark, sf)
    params = [c for c in e.columns if c.startswith("param_")]
    long = e.unpivot(["experiment_id"], params, "name", "value").select(
        "experiment_id", F.lit("param").alias("kind"), F.substring("name", 7, 1000).alias("name"), "value")
    m = MV.experiment_metrics(spark, sf).groupBy("experiment_id", F.col("metric").alias("name")).agg(F.max_by("value", "step").alias("value"))
    return long.where("value IS NOT NULL").unionByName(m.withColumn("kind", F.lit("metric")))


@query("experiment_matrix", f"""WITH {_NAMED_SQL} SELECT experiment_id, kind, name, round(value, 9) AS value FROM named""")
def experiment_matrix(spark, sf):
    """Parameters and metrics x experiments in long form; an absent row is an absent value,
    and no name is left out."""
    return _named_values(spark, sf).select("experiment_id", "kind", "name", rnd("value", 9).alias("value"))


@query("best_per_metric", f"""WITH {_LATEST_M}
SELECT metric, first(experiment_id ORDER BY CASE WHEN metric IN ('loss', 'error_rate', 'drift_score') THEN value ELSE -value END, experiment_id) AS best_experiment
FROM lm GROUP BY metric""")
def best_per_metric(spark, sf):
    """Best experiment per metric: highest, or lowest for loss / error_rate / drift_score."""
    lm = MV.experiment_metrics(spark, sf).groupBy("experiment_id", "metric").agg(F.max_by("value", "step").alias("value"))
    low = F.col("metric").isin("loss", "error_rate", "drift_score")
    x = lm.withColumn("_k", F.when(low, -F.col("value")).otherwise(F.col("value")))
    # ties: the smallest experiment id
    return x.groupBy("metric").agg(F.min_by("experiment_id", F.struct(-F.col("_k"), F.col("experiment_id"))).alias("best_experiment"))


@query("feature_union", f"WITH {_NAMED_SQL} SELECT DISTINCT kind, name FROM named")
def feature_union(spark, sf):
    """Union of names over experiments (parameters and metrics), distinct."""
    return _named_values(spark, sf).select("kind", "name").distinct()
