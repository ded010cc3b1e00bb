"""Catalog: linear attributions (X01), ensemble uncertainty (T13), model comparison pivot
(J08) and fallback error statistics (A09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES
from riskframe.functions.vecexpr import vmean
from riskframe.operators import metrics as M
from riskframe.operators import risk as K
from riskframe.plans.catalog import query
from riskframe.plans.q_metrics import _EVAL_SQL
from riskframe.sources import views

_Q = lambda c: f'"{c}"' if c == "Time" else c
# fixed example coefficients of a linear model over the 30 features (a rule, not fitted)
COEF = {c: ((j % 7) - 3) / 10.0 for j, c in enumerate(FEATURES)}
INTERCEPT = -2.0


_ATTR_SQL = ("m AS (SELECT " + ", ".join(f"avg({_Q(c)}) AS mu_{c}" for c in FEATURES) + " FROM txn), "
             "att AS (" + " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, {COEF[c]!r} * ({_Q(c)} - mu_{c}) AS attribution FROM txn, m" for c in FEATURES) + ")")


def attributions(spark, sf):
    """(event_id, feature, attribution): coef_j (x_j - background mean_j), one scalar row of means."""
    t = views.txn(spark, sf)
    x = t.withColumn("_mu", t.select(F.struct(*[F.avg(c).alias(c) for c in FEATURES])).scalar())
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(COEF[c]) * (F.col(c) - F.col("_mu")[c])).alias("attribution")) for c in FEATURES])
    return x.select("event_id", F.explode(rows).alias("a")).select("event_id", "a.*")


@query("linear_attribution", f"WITH {_ATTR_SQL} SELECT event_id, feature, round(attribution, 6) + 0.0 AS attribution FROM att")
def linear_attribution(spark, sf):
    """Per row and feature, coef_j (x_j - background mean_j) of a linear model."""
    return attributions(spark, sf).select("event_id", "feature", rnd("attribution").alias("attribution"))


@query("attribution_totals", f"""WITH {_ATTR_SQL}
SELECT a.event_id, round({INTERCEPT!r}""" + "".join(f" + {COEF[c]!r} * mu_{c}" for c in FEATURES) + """, 6) AS base,
  round(sum(attribution), 6) AS explained FROM att a, m GROUP BY ALL""")
def attribution_totals(spark, sf):
    """The base value (intercept + coef . means) and the sum of a row's attributions."""
    t = views.txn(spark, sf)
    mu = F.col("_mu")
    base = sum((F.lit(COEF[c]) * mu[c] for c in FEATURES), F.lit(INTERCEPT))
    part = sum((F.lit(COEF[c]) * (F.col(c) - mu[c]) for c in FEATURES), F.lit(0.0))
    return t.withColumn("_mu", t.select(F.struct(*[F.avg(c).alias(c) for c in FEATURES])).scalar()) \
        .select("event_id", rnd(base).alias("base"), rnd(part).alias("explained"))


@query("top_k_attributions", f"""WITH {_ATTR_SQL}
SELECT event_id, rank, feature, round(attribution, 6) + 0.0 AS attribution FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(abs(attribution), 6) DESC, feature) AS rank FROM att) WHERE rank <= 5""")
def top_k_attributions(spark, sf):
    """The five features of largest absolute attribution per row; a row-local sort of its features."""
    t = views.txn(spark, sf)
    x = t.withColumn("_mu", t.select(F.struct(*[F.avg(c).alias(c) for c in FEATURES])).scalar())
    rows = F.array(*[F.struct((-F.round(F.abs(a), 6)).alias("k"), F.lit(c).alias("feature"), a.alias("attribution"))
                     for c in FEATURES for a in [F.lit(COEF[c]) * (F.col(c) - F.col("_mu")[c])]])
    top = F.slice(F.array_sort(rows), 1, 5)
    return x.select("event_id", F.posexplode(top).alias("p", "a")) \
        .select("event_id", (F.col("p") + 1).cast("long").alias("rank"), "a.feature", rnd("a.attribution").alias("attribution"))


@query("importance_aggregate", f"""WITH {_ATTR_SQL}
SELECT feature, round(avg(abs(attribution)), 6) AS importance FROM att GROUP BY feature""")
def importance_aggregate(spark, sf):
    """Mean absolute attribution per feature over all rows."""
    return attributions(spark, sf).groupBy("feature").agg(rnd(F.avg(F.abs("attribution"))).alias("importance"))


@query("explanation_summary", f"""WITH {_ATTR_SQL}
SELECT feature, round(avg(attribution), 6) + 0.0 AS mean_attribution, round(stddev_pop(attribution), 6) AS std_attribution,
  round(avg(abs(attribution)), 6) AS mean_abs, round(max(abs(attribution)), 6) AS max_abs, count(*) FILTER (WHERE attribution > 0) AS n_positive FROM att GROUP BY feature""")
def explanation_summary(spark, sf):
    """Per feature, mean, spread, mean and largest absolute attribution, and how often it is positive."""
    a = F.col("attribution")
    return attributions(spark, sf).groupBy("feature").agg(
        rnd(F.avg(a)).alias("mean_attribution"), rnd(F.stddev_pop(a)).alias("std_attribution"), rnd(F.avg(F.abs(a))).alias("mean_abs"),
        rnd(F.max(F.abs(a))).alias("max_abs"), F.sum((a > 0).cast("long")).alias("n_positive"))


@query("normalise_contributions", f"""WITH {_ATTR_SQL}
SELECT event_id, feature, round(CASE WHEN sum(abs(attribution)) OVER (PARTITION BY event_id) > 0
  THEN attribution / sum(abs(attribution)) OVER (PARTITION BY event_id) ELSE 0.0 END, 6) + 0.0 AS share FROM att""")
def normalise_contributions(spark, sf):
    """Attributions over the sum of a row's absolute attributions (0 where that is 0); row-local."""
    t = views.txn(spark, sf)
    x = t.withColumn("_mu", t.select(F.struct(*[F.avg(c).alias(c) for c in FEATURES])).scalar())
    part = {c: F.lit(COEF[c]) * (F.col(c) - F.col("_mu")[c]) for c in FEATURES}
    total = sum((F.abs(p) for p in part.values()), F.lit(0.0))
    x = x.withColumn("_total", total)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), rnd(F.coalesce(F.try_divide(p, F.col("_total")), F.lit(0.0))).alias("share")) for c, p in part.items()])
    return x.select("event_id", F.explode(rows).alias("a")).select("event_id", "a.*")


_MEAN3 = [f"((M{i} + V{i} + ((M{i} + V{i}) / 2.0)) / 3.0)" for i in range(1, 29)]
_STD3 = [f"sqrt(((M{i} - {m}) * (M{i} - {m}) + (V{i} - {m}) * (V{i} - {m}) + (((M{i} + V{i}) / 2.0) - {m}) * (((M{i} + V{i}) / 2.0) - {m})) / 3.0)"
         for i, m in zip(range(1, 29), _MEAN3)]


@query("ensemble_uncertainty", " UNION ALL ".join(
    f"SELECT request_id, 'V{i}' AS component, round({m}, 9) AS estimate, round({d}, 9) AS std FROM mapping_rows"
    for i, (m, d) in enumerate(zip(_MEAN3, _STD3), 1)))
def ensemble_uncertainty(spark, sf):
    """Per request and component, mean and population std across three member outputs
    (mapped, original, midpoint); row-local, no shuffle."""
    m = views.mapping_rows(spark, sf)
    rows = F.array(*[F.struct(F.lit(f"V{i}").alias("component"), rnd(F.expr(e), 9).alias("estimate"), rnd(F.expr(d), 9).alias("std"))
                     for i, (e, d) in enumerate(zip(_MEAN3, _STD3), 1)])
    return m.select("request_id", F.explode(rows).alias("x")).select("request_id", "x.*")


@query("model_comparison", _EVAL_SQL + """
SELECT model, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  round(roc_auc, 9) AS roc_auc FROM ev""")
def model_comparison(spark, sf):
    """One row per model, one column per metric (long metrics pivoted on a closed list)."""
    ev = M.evaluation_record(views.model_scores(spark, sf), groups=["model"])
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    long = ev.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                                  for n in names])).alias("kv")).select("model", "kv.*")
    p = long.groupBy("model").pivot("metric", names).agg(F.first("value"))
    return p.select("model", *[rnd(n, 9).alias(n) for n in names])


_ERR_SQL = """e AS (SELECT request_id, CASE WHEN transaction_amount <= 0 THEN 'feature_mapping' WHEN transaction_amount > 50000 THEN 'prediction'
    WHEN hour_of_day < 0 OR hour_of_day > 23 THEN 'input_validation' END AS cat FROM requests),
c AS (SELECT unnest(['input_validation', 'model_loading', 'feature_mapping', 'prediction', 'performance', 'system', 'network', 'data_corruption']) AS category)"""


@query("error_statistics", f"""WITH {_ERR_SQL}
SELECT c.category, count(e.cat) AS errors,
  count(e.cat) FILTER (WHERE c.category IN ('feature_mapping', 'prediction', 'model_loading')) AS recovered,
  round(coalesce(100.0 * count(e.cat) FILTER (WHERE c.category IN ('feature_mapping', 'prediction', 'model_loading')) / nullif(count(e.cat), 0), 0.0), 2) AS recovery_pct,
  CASE c.category WHEN 'prediction' THEN 'high' WHEN 'model_loading' THEN 'critical' WHEN 'input_validation' THEN 'low' ELSE 'medium' END AS severity
FROM c LEFT JOIN e ON e.cat = c.category GROUP BY c.category""")
def error_statistics(spark, sf):
    """Errors per category (all eight, zero-filled), recovered count, recovery percentage (2 dp) and severity."""
    r = K.fallback_chain(views.requests(spark, sf))
    cats = spark.createDataFrame([(c, K.SEVERITY.get(c, "medium")) for c in K.ERROR_CATEGORIES], "category string, severity string")
    g = r.groupBy(F.col("error_category").alias("category")).agg(
        F.count(F.lit(1)).alias("errors"), F.sum(F.col("recovered").cast("long")).alias("recovered"))
    j = cats.join(g, "category", "left").na.fill(0, ["errors", "recovered"])
    return j.select("category", "errors", "recovered",
                    F.round(F.coalesce(F.try_divide(100.0 * F.col("recovered"), F.col("errors")), F.lit(0.0)), 2).alias("recovery_pct"), "severity")


@query("fallback_performance", f"""WITH {_ERR_SQL},
s AS (SELECT cat, CASE WHEN cat IN ('feature_mapping', 'prediction', 'model_loading') THEN 'conservative_mapping' END AS strategy FROM e WHERE cat IS NOT NULL)
SELECT n.strategy, count(s.cat) AS success_count, round(coalesce(count(s.cat) / nullif((SELECT count(*) FROM s), 0), 0.0), 9) AS share_of_errors
FROM (SELECT unnest(['conservative_mapping', 'dataset_average', 'simplified_model']) AS strategy) n LEFT JOIN s ON s.strategy = n.strategy GROUP BY n.strategy""")
def fallback_performance(spark, sf):
    """What each fallback strategy recovered, and its share of all errors (zero-filled)."""
    r = K.fallback_chain(views.requests(spark, sf))
    names = spark.createDataFrame([(s[0],) for s in K.DEFAULT_STRATEGIES], "strategy string")
    n = r.select(F.count(F.lit(1))).scalar()
    g = r.groupBy("strategy").agg(F.count(F.lit(1)).alias("success_count"))
    return names.join(g, "strategy", "left").na.fill(0, ["success_count"]).withColumn("n", n) \
        .select("strategy", "success_count", rnd(F.coalesce(F.try_divide(F.col("success_count"), F.col("n")), F.lit(0.0)), 9).alias("share_of_errors"))


@query("recent_errors", f"""WITH {_ERR_SQL}
SELECT request_id, cat AS category, cat IN ('feature_mapping', 'prediction', 'model_loading') AS recovered
FROM e JOIN requests USING (request_id) WHERE cat IS NOT NULL ORDER BY ts DESC, request_id DESC LIMIT 10""")
def recent_errors(spark, sf):
    """The last ten errors."""
    r = K.fallback_chain(views.requests(spark, sf))
    return r.orderBy(F.desc("ts"), F.desc("request_id")).limit(10).select("request_id", F.col("error_category").alias("category"), "recovered")
