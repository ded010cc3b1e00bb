"""Catalog: reports, alerts and written results (A07, D08, D11, G04, G10, J04, J07, M10, M11,
S03, S09, S11, S12, U05, X04, X06, X07, X09)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import bounds as B
from riskframe.operators import metrics as M
from riskframe.operators.neighbours import spread
from riskframe.operators import reports as P
from riskframe.operators import sampling
from riskframe.plans import q_quality, q_sampling  # noqa: F401  (their oracles are parts of those below)
from riskframe.operators.align import REQUIRED_FIELDS
from riskframe.plans.q_align import raw_requests
from riskframe.plans.catalog import ORACLE, QUERIES, query
from riskframe.plans.q_explain import _ATTR_SQL, _Q, COEF, attributions
from riskframe.plans.q_metrics import _EVAL_SQL
from riskframe.plans.q_registry import _NAMED_SQL, _named_values
from riskframe.plans.q_risk import _ASM_SQL, _BND_SQL, _LONG_SQL, assembled, bounds_table
from riskframe.session import checkpoint_dir
from riskframe.sources import metadata_views as MV
from riskframe.sources import views
from riskframe.sources.tables import table


def _evaluations(spark, sf):
    return M.evaluation_record(views.model_scores(spark, sf), groups=["model"])


@query("performance_summary", _EVAL_SQL + """
SELECT count(*) AS models, round(avg(roc_auc), 9) AS mean_auc, round(max(roc_auc), 9) AS best_auc,
  string_agg(model || '=' || CAST(round(recall, 6) AS VARCHAR), ',' ORDER BY model) AS recall_by_model FROM ev""")
def performance_summary(spark, sf):
    """Mean and best AUC, number of models, recall of every model."""
    s = P.performance_summary(_evaluations(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("recall_by_model")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string")))
    return s.select("models", rnd("mean_auc", 9).alias("mean_auc"), rnd("best_auc", 9).alias("best_auc"), F.array_join(pairs, ",").alias("recall_by_model"))


_ALERT_SQL = """SELECT version_id, model_type, 'mse_above_limit' AS code, 'medium' AS severity, round((1 - accuracy) * 5, 9) AS value, 0.5::DOUBLE AS "limit"
FROM model_versions WHERE is_production AND (1 - accuracy) * 5 > 0.5
UNION ALL SELECT version_id, model_type, 'correlation_below_limit', 'high', round(f1 - 0.2, 9), 0.7 FROM model_versions WHERE is_production AND f1 - 0.2 < 0.7"""


@query("mapper_alerts", _ALERT_SQL)
def mapper_alerts(spark, sf):
    """D08; stand-in figures of a version: mse is 5 (1 - accuracy), mean correlation is f1 less .2."""
    v = MV.model_versions(spark, sf).withColumns({"mse": (1 - F.col("accuracy")) * 5, "avg_correlation": F.col("f1") - 0.2})
    return P.mapper_alerts(v).withColumn("value", rnd("value", 9))


_BATCH_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "error_rate", "latency_ms", "throughput", "band_low", "band_medium", "band_high", "drift_score"]


@query("monitor_batch", """WITH r AS (SELECT m.model, CAST(e.ts AS DATE) AS batch, m.y, m.pred, m.p, e.value AS ms FROM model_scores m JOIN events e ON m.event_id = e.event_id),
s AS (SELECT model, batch, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM r GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model, batch ORDER BY p) - neg / 2.0 AS below, sum(pos) OVER w AS a, sum(neg) OVER w AS b FROM s
  WINDOW w AS (PARTITION BY model, batch)),
u AS (SELECT model, batch, CASE WHEN a = 0 OR b = 0 OR count(*) < 2 THEN 0.5 ELSE sum(pos * below) / (a * b) END AS roc_auc FROM c GROUP BY model, batch, a, b),
g AS (SELECT model, batch, count(*) AS n, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND pred <> 1) AS fn, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS accuracy, avg(ms) AS latency_ms,
  count(*) * 1000.0 / nullif(sum(ms), 0) AS throughput, avg(CASE WHEN p >= 0 AND p < 0.3 THEN 1.0 ELSE 0.0 END) AS band_low,
  avg(CASE WHEN p >= 0.3 AND p < 0.7 THEN 1.0 ELSE 0.0 END) AS band_medium, avg(CASE WHEN p >= 0.7 AND p <= 1 THEN 1.0 ELSE 0.0 END) AS band_high,
  CASE WHEN avg(p) <> 0 THEN stddev_pop(p) / abs(avg(p)) END AS cp, CASE WHEN avg(ms) <> 0 THEN stddev_pop(ms) / abs(avg(ms)) END AS cm FROM r GROUP BY ALL),
x AS (SELECT g.*, u.roc_auc, 1 - accuracy AS error_rate, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, coalesce(least(list_avg([cp, cm]) / 2, 1.0), 0.0) AS drift_score
  FROM g JOIN u ON g.model = u.model AND g.batch = u.batch)
SELECT model, batch, n, """ + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _BATCH_METRICS) + " FROM x")
def monitor_batch(spark, sf):
    """A history row per model and day of scored events."""
    ev = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("batch"), F.col("value").alias("ms"))
    scored = views.model_scores(spark, sf).join(ev, "event_id")
    return P.monitor_batch(scored, ["model", "batch"], "ms", ["p", "ms"]).select("model", "batch", "n", *[rnd(c, 6).alias(c) for c in _BATCH_METRICS])


_OUTCOME_SQL = """o AS (SELECT version_id, model_type, is_healthy, coalesce(last_value(CASE WHEN is_healthy THEN version_id END IGNORE NULLS) OVER past,
  first_value(version_id) OVER past) AS previous_champion FROM (SELECT *, accuracy >= 0.5 AND f1 >= 0.5 AS is_healthy FROM registrations)
  WINDOW past AS (PARTITION BY model_type ORDER BY registered_at, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, NOT is_healthy AND previous_champion IS NOT NULL AS rolled_back FROM o)"""


def _outcomes(spark, sf):
    return P.deployment_outcomes(MV.registrations(spark, sf), (F.col("accuracy") >= 0.5) & (F.col("f1") >= 0.5))


@query("deployment_outcomes", f"""WITH {_OUTCOME_SQL} SELECT version_id, model_type, is_healthy, previous_champion, rolled_back, is_healthy OR rolled_back AS success,
  CASE WHEN rolled_back THEN previous_champion ELSE version_id END AS champion_after FROM d""")
def deployment_outcomes(spark, sf):
    """Every registration deployed as champion; healthy from an accuracy and f1 of .5."""
    return _outcomes(spark, sf)


@query("batch_deployment", f"""WITH {_OUTCOME_SQL} SELECT model_type, count(*) AS total, count(*) FILTER (WHERE is_healthy OR rolled_back) AS successful,
  count(*) FILTER (WHERE NOT (is_healthy OR rolled_back)) AS failed, count(*) FILTER (WHERE rolled_back) AS rolled_back FROM d GROUP BY model_type""")
def batch_deployment(spark, sf):
    """The counts of a batch, per model."""
    return P.batch_outcome(_outcomes(spark, sf))


@query("experiment_comparison", f"""WITH {_NAMED_SQL}, ch AS (SELECT experiment_id FROM experiments WHERE status = 'completed'),
x AS (SELECT *, (SELECT count(*) FROM ch) AS n_experiments FROM named WHERE value IS NOT NULL AND experiment_id IN (SELECT experiment_id FROM ch)),
b AS (SELECT name, first(experiment_id ORDER BY CASE WHEN name IN ('loss', 'error_rate', 'drift_score') THEN value ELSE -value END, experiment_id) AS best
  FROM x WHERE kind = 'metric' GROUP BY name)
SELECT kind, x.name, experiment_id, round(value, 9) AS value, n_experiments, coalesce(kind = 'metric' AND experiment_id = best, false) AS is_best
FROM x LEFT JOIN b ON x.name = b.name WHERE n_experiments >= 2""")
def experiment_comparison(spark, sf):
    """All completed experiments compared."""
    done = MV.experiments(spark, sf).where("status = 'completed'").select("experiment_id")
    return P.experiment_comparison(_named_values(spark, sf), done).withColumn("value", rnd("value", 9))


@query("dashboard_frame", _EVAL_SQL + ", cv AS (" + ORACLE["cv_summary"] + """)
SELECT ev.model, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(f1, 9) AS f1, cv.test_mean AS cv_auc_mean, cv.test_std AS cv_auc_std, n AS samples, tn, fp, fn, tp,
  ev.model = (SELECT first(model ORDER BY round(roc_auc, 9) DESC, model) FROM ev) AS is_best FROM ev JOIN cv ON cv.model = ev.model AND cv.metric = 'roc_auc'""")
def dashboard_frame(spark, sf):
    """A row per model."""
    ev = _evaluations(spark, sf)
    ev = ev.select(*[rnd(c, 9).alias(c) if t == "double" else F.col(c) for c, t in ev.dtypes])
    cv = M.cv_summary(views.model_scores(spark, sf).join(views.folds(spark, sf).select("event_id", "fold"), "event_id"))
    return P.dashboard_frame(ev, cv).withColumns({c: rnd(c, 9) for c in ("cv_auc_mean", "cv_auc_std")})


@query("insight_tier", _EVAL_SQL + """, overall AS (SELECT count(*) AS models, avg(roc_auc) AS mean_auc FROM ev)
SELECT models, round(mean_auc, 9) AS mean_auc, CASE WHEN mean_auc >= 0.9 THEN 'excellent' WHEN mean_auc >= 0.8 THEN 'good' WHEN mean_auc >= 0.7 THEN 'fair'
  ELSE 'needs_improvement' END AS tier, CASE WHEN mean_auc >= 0.9 THEN 'low' WHEN mean_auc >= 0.8 THEN 'medium' WHEN mean_auc >= 0.7 THEN 'medium_high' ELSE 'high' END AS risk,
  concat_ws(',', CASE WHEN models >= 5 THEN 'model_diversity' END, CASE WHEN mean_auc >= 0.8 THEN 'predictive_performance' END) AS strengths,
  concat_ws(',', CASE WHEN mean_auc < 0.8 THEN 'improve_features' END, 'monitor_continuously', 'retrain_on_schedule') AS advice FROM overall WHERE models > 0""")
def insight_tier(spark, sf):
    """Tier, risk, strengths and advice of the trained models."""
    return P.insight_tier(_evaluations(spark, sf)).withColumns({"mean_auc": rnd("mean_auc", 9), "strengths": F.array_join("strengths", ","),
                                                               "advice": F.array_join("advice", ",")})


def _folder(spark, tag):
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@query("write_split", ORACLE["stratified_split"])
def write_split(spark, sf):
    """Train and test written to folders of their own, and read back."""
    path = _folder(spark, "split-sets")
    P.write_split(sampling.stratified_split(views.txn(spark, sf).select("event_id", "Class"), "Class", "event_id", 0.2, 42), path)
    return spark.read.schema("event_id long, Class int, split string").parquet(path)


_STATS = "feature string, min double, max double, mean double, std double"


@query("stats_artifacts", f"WITH {_BND_SQL} SELECT feature, min, max, round(mean, 6) AS mean, round(std, 6) AS std FROM bnd")
def stats_artifacts(spark, sf):
    """Feature statistics saved and reloaded."""
    path = _folder(spark, "stats")
    P.save_stats({"features": B.feature_bounds(views.txn(spark, sf))}, path)
    return P.load_stats(spark, path, {"features": _STATS})["features"].withColumns({c: rnd(c, 6) for c in ("mean", "std")})


@query("report_export", _EVAL_SQL + """ SELECT model, round(roc_auc, 9) AS auc, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  round(accuracy, 9) AS accuracy FROM ev""")
def report_export(spark, sf):
    """Metrics written as JSON and CSV; the rows that both files hold."""
    path = _folder(spark, "report")
    P.export_report(_evaluations(spark, sf), path)
    return spark.read.schema(P.REPORT_SCHEMA).option("header", True).csv(f"{path}/csv").intersect(spark.read.schema(P.REPORT_SCHEMA).json(f"{path}/json"))


@query("assessment_record", "SELECT (SELECT max(ts) FROM events) AS assessed_at, r.* FROM (" + ORACLE["quality_report"] + ") r")
def assessment_record(spark, sf):
    """The quality report with the time of the newest event, appended to the assessments and read back."""
    path = _folder(spark, "assessments")
    P.append_assessment(QUERIES["quality_report"](spark, sf), table(spark, sf, "events").select(F.max("ts")).scalar(), path)
    return spark.read.parquet(path).select("assessed_at", "report.*")


@query("simple_attribution", " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, {abs(COEF[c])!r}::DOUBLE * {_Q(c)} + 0.0 AS contribution, 0.5::DOUBLE AS base FROM txn"
                                                for c in FEATURES))
def simple_attribution(spark, sf):
    """Importance times value, with the example model's absolute coefficients."""
    return P.simple_attribution(views.txn(spark, sf), FEATURES, {c: abs(v) for c, v in COEF.items()}).withColumn("contribution", F.col("contribution") + 0.0)


@query("importance_comparison", f"""WITH {_ATTR_SQL}, k AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {abs(COEF[c])!r}::DOUBLE)" for c in FEATURES)}) t(feature, linear)),
a AS (SELECT feature, avg(abs(attribution)) AS attribution FROM att GROUP BY feature)
SELECT feature, round(linear, 6) AS linear, round(attribution, 6) AS attribution, round((linear + attribution) / 2, 6) AS mean_importance
FROM k JOIN a USING (feature) ORDER BY mean_importance DESC, feature LIMIT 15""")
def importance_comparison(spark, sf):
    """Absolute coefficients against mean absolute attributions."""
    linear = spark.createDataFrame([("linear", c, float(v)) for c, v in COEF.items()], "model string, feature string, importance double")
    att = attributions(spark, sf).groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance")).select(F.lit("attribution").alias("model"), "feature", "importance")
    r = P.importance_comparison(linear.union(att), ["linear", "attribution"])
    return r.select("feature", *[rnd(c).alias(c) for c in ("linear", "attribution", "mean_importance")])


@query("bounds_join", f"""WITH {_ASM_SQL}, {_LONG_SQL}, {_BND_SQL}
SELECT request_id, l.feature, value, min, max FROM lng l JOIN bnd b ON l.feature = b.feature""")
def bounds_join(spark, sf):
    """Every value of the assembled vectors with its feature's bounds (30 rows, broadcast)."""
    return B.to_long(assembled(spark, sf), "request_id").join(F.broadcast(bounds_table(spark, sf)), "feature").select("request_id", "feature", "value", "min", "max")


@query("pair_original_mapped", " UNION ALL ".join(
    f"SELECT t.event_id, 'V{i}' AS component, round(V{i}, 9) AS original, round(M{i}, 9) AS mapped FROM txn t JOIN mapped m ON t.event_id = m.event_id" for i in range(1, 29)))
def pair_original_mapped(spark, sf):
    """Original and mapped components side by side, aligned by id."""
    j = views.txn(spark, sf).select("event_id", *V_NAMES).join(views.mapped(spark, sf), "event_id")
    rows = F.array(*[F.struct(F.lit(f"V{i}").alias("component"), rnd(f"V{i}", 9).alias("original"), rnd(f"M{i}", 9).alias("mapped")) for i in range(1, 29)])
    return j.select("event_id", F.explode(rows).alias("x")).select("event_id", "x.*")


_REPORT_PARTS = ["narrate_request", "narrate_mapping", "component_summary", "interval_summary", "request_recommendations"]


@query("mapping_report", "SELECT * FROM " + " JOIN ".join(f"({ORACLE[q]}) p{i}" + (" USING (request_id)" if i else "") for i, q in enumerate(_REPORT_PARTS)))
def mapping_report(spark, sf):
    """Narrative, main inputs, summary of components and intervals, and advice of every request, row-local."""
    parts = [QUERIES[q](spark, sf) for q in _REPORT_PARTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "request_id")
    return out


@query("compare_explainers", f"""WITH {_ATTR_SQL}, simple AS ({" UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, {abs(COEF[c])!r}::DOUBLE * {_Q(c)} AS contribution FROM txn" for c in FEATURES)}),
r AS (SELECT event_id, feature, attribution AS a, contribution AS b, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(attribution), 6) DESC, feature) AS first_rank,
  row_number() OVER (PARTITION BY event_id ORDER BY round(abs(contribution), 6) DESC, feature) AS second_rank FROM att JOIN simple USING (event_id, feature))
SELECT event_id, feature, round(a, 3) + 0.0 AS first, round(b, 3) + 0.0 AS second, first_rank, second_rank,
  round(1 - 6.0 * sum((first_rank - second_rank) * (first_rank - second_rank)) OVER (PARTITION BY event_id) / {30 * 899}.0, 6) AS agreement FROM r""")
def compare_explainers(spark, sf):
    """Linear attributions (X01) against importance times value (X04) on every transaction."""
    t = views.txn(spark, sf)
    x = t.withColumn("_mu", t.select(F.struct(*[F.avg(c).alias(c) for c in FEATURES])).scalar())
    r = P.compare_explainers(spread(x), FEATURES, {c: F.lit(COEF[c]) * (F.col(c) - F.col("_mu")[c]) for c in FEATURES}, {c: F.lit(abs(COEF[c])) * F.col(c) for c in FEATURES})
    return r.withColumns({"first": rnd("first", 3) + 0.0, "second": rnd("second", 3) + 0.0, "agreement": rnd("agreement")})


@query("missing_features", """SELECT request_id, unnest(list_filter([CASE WHEN request_id % 11 = 0 THEN 'merchant_category' END,
  CASE WHEN request_id % 13 = 0 THEN 'hour_of_day' END, CASE WHEN request_id % 17 = 0 THEN 'spending_pattern' END], lambda v: v IS NOT NULL)) AS feature FROM requests""")
def missing_features(spark, sf):
    """The expected fields that a request's body does not have, one row each."""
    body = raw_requests(spark, sf)
    keys = F.coalesce(F.expr("json_object_keys(body)"), F.array().cast("array<string>"))
    return body.select("request_id", F.explode(F.array_except(F.array(*[F.lit(c) for c in REQUIRED_FIELDS]), keys)).alias("feature"))
