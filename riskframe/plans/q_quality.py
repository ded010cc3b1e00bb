"""Catalog: mapping quality (Q01-Q08) and drift / anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import drift as D
from riskframe.operators import quality as Q
from riskframe.plans.catalog import query
from riskframe.sources import views

MC = [f"M{i}" for i in range(1, 29)]
_Q = lambda c: f'"{c}"' if c == "Time" else c


def _vm(spark, sf):
    t = views.txn(spark, sf)
    return t.select("event_id", *V_NAMES, *[(F.lit(0.9) * F.col(f"V{i}") + F.lit(0.1) * F.col(f"V{i % 28 + 1}")).alias(f"M{i}")
                                            for i in range(1, 29)])


_PAIRS = [(i, j) for i in range(1, 29) for j in range(i + 1, 29)]
_Q01_SQL = ("WITH c AS (SELECT " + ", ".join(f"corr(V{i}, V{j}) AS a{i}_{j}, corr(M{i}, M{j}) AS b{i}_{j}" for i, j in _PAIRS)
            + " FROM txn JOIN mapped USING (event_id)), p AS (" + " UNION ALL ".join(
                f"SELECT coalesce(a{i}_{j}, 0.0) AS a, coalesce(b{i}_{j}, 0.0) AS b FROM c" for i, j in _PAIRS)
            + ") SELECT round(greatest(0.0, least(1.0, (coalesce(corr(a, b), 0.0) + 1) / 2)), 6) AS correlation_preservation FROM p")


@query("correlation_preservation", _Q01_SQL)
def correlation_preservation(spark, sf):
    x = _vm(spark, sf)
    r = Q.correlation_preservation(x, x, V_NAMES, MC)
    return r.select(rnd("correlation_preservation", 6).alias("correlation_preservation"))


def _long(spark, sf):
    x = _vm(spark, sf)
    return x.select(F.explode(F.array(*(
        [F.struct(F.lit(f"V{i}").alias("component"), F.lit("o").alias("source"), F.col(f"V{i}").alias("value")) for i in range(1, 29)]
        + [F.struct(F.lit(f"V{i}").alias("component"), F.lit("m").alias("source"), F.col(f"M{i}").alias("value")) for i in range(1, 29)]
    ))).alias("kv")).select("kv.*")


_LONG_SQL = "long AS (" + " UNION ALL ".join(
    [f"SELECT 'V{i}' AS component, 'o' AS source, V{i} AS value FROM txn" for i in range(1, 29)]
    + [f"SELECT 'V{i}' AS component, 'm' AS source, M{i} AS value FROM mapped" for i in range(1, 29)]) + ")"
_JS_SQL = f"""{_LONG_SQL},
rng AS (SELECT component, min(value) AS lo, max(value) AS hi FROM long GROUP BY component),
b AS (SELECT l.component, source, CAST(least(floor((value - lo) / (CASE WHEN (hi - lo) / 49 > 0 THEN (hi - lo) / 49 ELSE 1.0 END)), 48) AS INTEGER) AS bin
      FROM long l JOIN rng ON l.component = rng.component),
cnt AS (SELECT component, bin, sum(CASE WHEN source = 'o' THEN 1.0 ELSE 0.0 END) AS co,
        sum(CASE WHEN source = 'm' THEN 1.0 ELSE 0.0 END) AS cm FROM b GROUP BY component, bin),
g0 AS (SELECT r.component, t.bin, coalesce(co, 0.0) AS co, coalesce(cm, 0.0) AS cm
       FROM rng r CROSS JOIN range(0, 49) t(bin) LEFT JOIN cnt ON cnt.component = r.component AND cnt.bin = t.bin),
g1 AS (SELECT *, co / sum(co) OVER (PARTITION BY component) + 1e-10 AS p0, cm / sum(cm) OVER (PARTITION BY component) + 1e-10 AS q0 FROM g0),
g2 AS (SELECT *, p0 / sum(p0) OVER (PARTITION BY component) AS p, q0 / sum(q0) OVER (PARTITION BY component) AS q FROM g1),
js AS (SELECT component, 1 - sqrt(greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0.0)) AS similarity
       FROM g2 GROUP BY component)"""


@query("distribution_similarity", f"WITH {_JS_SQL} SELECT component, round(similarity, 6) AS similarity FROM js")
def distribution_similarity(spark, sf):
    r = Q.distribution_similarity(_long(spark, sf))
    return r.select("component", rnd("similarity", 6).alias("similarity"))


_PAIR_SQL = "pp AS (SELECT a.p AS p1, b.p AS p2 FROM model_scores a JOIN model_scores b ON a.event_id = b.event_id AND a.model = 'm1' AND b.model = 'm2')"


def _pairs(spark, sf):
    ms = views.model_scores(spark, sf)
    a = ms.filter(F.col("model") == "m1").select("event_id", F.col("p").alias("p1"))
    b = ms.filter(F.col("model") == "m2").select("event_id", F.col("p").alias("p2"))
    return a.join(b, "event_id")


@query("prediction_consistency", f"""WITH {_PAIR_SQL}
SELECT round(agree, 9) AS agree, round(r, 6) AS r, round(greatest(0.0, least(1.0, (agree + greatest(0.0, coalesce(r, 0.0))) / 2)), 6) AS prediction_consistency
FROM (SELECT avg(CASE WHEN abs(p1 - p2) <= 0.1 THEN 1.0 ELSE 0.0 END) AS agree, corr(p1, p2) AS r FROM pp)""")
def prediction_consistency(spark, sf):
    r = Q.prediction_consistency(_pairs(spark, sf))
    return r.select(rnd("agree", 9).alias("agree"), rnd("r", 6).alias("r"),
                    rnd("prediction_consistency", 6).alias("prediction_consistency"))


_UNC_SQL = ("SELECT round(least(1.0, (" + " + ".join(f"var_pop(M{i})" for i in range(1, 29)) + ") / 28 / 5), 6) AS uncertainty_from_variance, "
            "round(least(1.0, (" + " + ".join(f"avg(U{i})" for i in range(1, 29)) + ") / 28 / 2), 6) AS uncertainty_from_estimates FROM mapping_rows")


@query("mapping_uncertainty", _UNC_SQL)
def mapping_uncertainty(spark, sf):
    r = Q.mapping_uncertainty(views.mapping_rows(spark, sf), MC, [f"U{i}" for i in range(1, 29)])
    return r.select(rnd("uncertainty_from_variance", 6).alias("uncertainty_from_variance"),
                    rnd("uncertainty_from_estimates", 6).alias("uncertainty_from_estimates"))


def _quality_score(spark, sf):
    cp = correlation_preservation(spark, sf).select("correlation_preservation").scalar()
    ds = Q.distribution_similarity(_long(spark, sf)).select(F.avg("similarity")).scalar()
    pc = Q.prediction_consistency(_pairs(spark, sf)).select("prediction_consistency").scalar()
    un = Q.mapping_uncertainty(views.mapping_rows(spark, sf), MC, None).select("uncertainty_from_variance").scalar()
    return cp, ds, pc, un


_Q05_INNER = f"""WITH {_JS_SQL}, {_PAIR_SQL},
cp AS ({_Q01_SQL}),
pc AS (SELECT greatest(0.0, least(1.0, (agree + greatest(0.0, coalesce(r, 0.0))) / 2)) AS v FROM (
  SELECT avg(CASE WHEN abs(p1 - p2) <= 0.1 THEN 1.0 ELSE 0.0 END) AS agree, corr(p1, p2) AS r FROM pp)),
un AS (SELECT least(1.0, ({" + ".join(f"var_pop(M{i})" for i in range(1, 29))}) / 28 / 5) AS v FROM mapped),
sc AS (SELECT cp.correlation_preservation AS c, (SELECT avg(similarity) FROM js) AS d, pc.v AS p, un.v AS u FROM cp, pc, un)"""


@query("mapping_quality", _Q05_INNER + """
SELECT round(0.3 * c + 0.3 * d + 0.3 * p + 0.1 * (1 - u), 5) AS quality_score FROM sc""")
def mapping_quality(spark, sf):
    """Q05: 0.3 Q01 + 0.3 Q02 + 0.3 Q03 + 0.1 (1 - Q04): one-row frames combined as scalars."""
    cp, ds, pc, un = _quality_score(spark, sf)
    one = spark.range(1)
    return one.select(F.round(0.3 * cp + 0.3 * ds + 0.3 * pc + 0.1 * (1 - un), 5).alias("quality_score"))


_STATS_SQL = ("st AS (" + " UNION ALL ".join(
    f"SELECT 'V{i}' AS component, avg(V{i}) AS mean_o, stddev_pop(V{i}) AS std_o, avg(M{i}) AS mean_m, stddev_pop(M{i}) AS std_m, "
    f"avg(CASE WHEN M{i} >= 0.8 * (SELECT min(V{i}) FROM txn) AND M{i} <= 1.2 * (SELECT max(V{i}) FROM txn) THEN 1.0 ELSE 0.0 END) AS inrange "
    f"FROM txn JOIN mapped USING (event_id)" for i in range(1, 29)) + ")")


@query("reference_validation", f"""WITH {_STATS_SQL},
s AS (SELECT *, coalesce(abs(mean_m - mean_o) / nullif(abs(mean_o), 0), 0.0) AS a, coalesce(abs(std_m - std_o) / nullif(std_o, 0), 0.0) AS b FROM st)
SELECT component, round(a, 6) AS mean_rel_error, round(b, 6) AS std_rel_error, round(inrange, 9) AS inrange,
  round(greatest(0.0, 1 - (a + b) / 2), 6) AS score, round(avg(greatest(0.0, 1 - (a + b) / 2)) OVER (), 6) AS overall_score FROM s""")
def reference_validation(spark, sf):
    x = _vm(spark, sf)
    mm = x.select(F.struct(*[F.struct(F.min(f"V{i}").alias("lo"), F.max(f"V{i}").alias("hi")).alias(f"V{i}")
                             for i in range(1, 29)])).scalar()
    x = x.withColumn("_mm", mm)
    st = x.select(F.explode(F.array(*[F.struct(
        F.lit(f"V{i}").alias("component"), F.col(f"V{i}").alias("o"), F.col(f"M{i}").alias("m"),
        ((F.col(f"M{i}") >= 0.8 * F.col("_mm")[f"V{i}"]["lo"]) & (F.col(f"M{i}") <= 1.2 * F.col("_mm")[f"V{i}"]["hi"]))
        .cast("double").alias("ok")) for i in range(1, 29)])).alias("kv")).select("kv.*")
    stats = st.groupBy("component").agg(F.avg("o").alias("mean_o"), F.stddev_pop("o").alias("std_o"),
                                         F.avg("m").alias("mean_m"), F.stddev_pop("m").alias("std_m"),
                                         F.avg("ok").alias("inrange"))
    r = Q.reference_validation(stats)
    overall = r.select(F.avg("score")).scalar()
    return r.select("component", rnd("mean_rel_error").alias("mean_rel_error"), rnd("std_rel_error").alias("std_rel_error"),
                    rnd("inrange", 9).alias("inrange"), rnd("score").alias("score"), rnd(overall).alias("overall_score"))


@query("quality_report", _Q05_INNER + f"""
SELECT round(s, 5) AS quality_score, {Q.QUALITY_LEVEL} AS quality_level,
  CASE WHEN c >= 0.8 THEN 'correlations_preserved' ELSE 'correlations_weak' END AS correlation_note,
  CASE WHEN d >= 0.8 THEN 'distributions_similar' ELSE 'distributions_differ' END AS distribution_note,
  CASE WHEN p >= 0.8 THEN 'predictions_consistent' ELSE 'predictions_inconsistent' END AS consistency_note,
  CASE WHEN u <= 0.3 THEN 'uncertainty_low' ELSE 'uncertainty_high' END AS uncertainty_note,
  coalesce(NULLIF(concat_ws(',', CASE WHEN c < 0.7 THEN 'improve_correlation_structure' END,
    CASE WHEN d < 0.7 THEN 'recalibrate_distributions' END, CASE WHEN p < 0.7 THEN 'review_prediction_consistency' END,
    CASE WHEN u > 0.5 THEN 'reduce_uncertainty' END), ''), 'quality_acceptable') AS recommendations
FROM (SELECT *, round(0.3 * c + 0.3 * d + 0.3 * p + 0.1 * (1 - u), 5) AS s FROM sc)""")
def quality_report(spark, sf):
    """Q07: quality level, four interpretations and recommendation codes."""
    cp, ds, pc, un = _quality_score(spark, sf)
    one = spark.range(1).select(F.lit(cp).alias("c"), F.lit(ds).alias("d"), F.lit(pc).alias("p"), F.lit(un).alias("u"))
    x = one.withColumn("s", F.round(0.3 * F.col("c") + 0.3 * F.col("d") + 0.3 * F.col("p") + 0.1 * (1 - F.col("u")), 5))
    rec = F.coalesce(F.expr("NULLIF(concat_ws(',', CASE WHEN c < 0.7 THEN 'improve_correlation_structure' END, "
                            "CASE WHEN d < 0.7 THEN 'recalibrate_distributions' END, CASE WHEN p < 0.7 THEN 'review_prediction_consistency' END, "
                            "CASE WHEN u > 0.5 THEN 'reduce_uncertainty' END), '')"), F.lit("quality_acceptable"))
    return x.select(F.col("s").alias("quality_score"), F.expr(Q.QUALITY_LEVEL).alias("quality_level"),
                    F.when(F.col("c") >= 0.8, "correlations_preserved").otherwise("correlations_weak").alias("correlation_note"),
                    F.when(F.col("d") >= 0.8, "distributions_similar").otherwise("distributions_differ").alias("distribution_note"),
                    F.when(F.col("p") >= 0.8, "predictions_consistent").otherwise("predictions_inconsistent").alias("consistency_note"),
                    F.when(F.col("u") <= 0.3, "uncertainty_low").otherwise("uncertainty_high").alias("uncertainty_note"),
                    rec.alias("recommendations"))


@query("mapping_error", "WITH e AS (" + " UNION ALL ".join(
    f"SELECT 'V{i}' AS component, avg((M{i} - V{i}) * (M{i} - V{i})) AS mse, avg(abs(M{i} - V{i})) AS mae, corr(M{i}, V{i}) AS r "
    f"FROM txn JOIN mapped USING (event_id)" for i in range(1, 29)) + """)
SELECT component, round(mse, 6) AS mse, round(mae, 6) AS mae, round(r, 6) AS corr FROM e
UNION ALL SELECT 'overall', round(avg(mse), 6), round(avg(mae), 6), round(greatest(0.0, coalesce(avg(r), 0.0)), 6) FROM e""")
def mapping_error(spark, sf):
    """Q08: per component MSE, MAE, Pearson of mapped vs original; overall means (undefined
    correlations ignored, floor 0)."""
    x = _vm(spark, sf)
    long = x.select(F.explode(F.array(*[F.struct(F.lit(f"V{i}").alias("component"), F.col(f"M{i}").alias("m"),
                                                 F.col(f"V{i}").alias("v")) for i in range(1, 29)])).alias("kv")).select("kv.*")
    e = long.groupBy("component").agg(F.avg((F.col("m") - F.col("v")) ** 2).alias("mse"),
                                      F.avg(F.abs(F.col("m") - F.col("v"))).alias("mae"), F.corr("m", "v").alias("r"))
    o = e.agg(F.lit("overall").alias("component"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae"),
              F.greatest(F.lit(0.0), F.coalesce(F.avg("r"), F.lit(0.0))).alias("r"))
    return e.unionByName(o).select("component", rnd("mse").alias("mse"), rnd("mae").alias("mae"), rnd("r").alias("corr"))


# ---- drift / anomalies: baseline = first 14 days, current = the rest ----------------------
_SPLIT = 14 * 86400


def _periods(spark, sf):
    t = views.txn(spark, sf).select("event_id", *FEATURES, "Class")
    return t.filter(F.col("Time") < _SPLIT), t.filter(F.col("Time") >= _SPLIT)


def _stats_sql(where):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({_Q(c)}) AS mean, stddev_pop({_Q(c)}) AS std FROM txn WHERE {where}" for c in FEATURES)


@query("drift_zscore", f"""WITH b AS ({_stats_sql(f'"Time" < {_SPLIT}')}), c AS ({_stats_sql(f'"Time" >= {_SPLIT}')})
SELECT round(avg(CASE WHEN b.std > 0 THEN least(abs(c.mean - b.mean) / b.std / 3, 1.0) ELSE 0.0 END), 6) AS drift_score
FROM b JOIN c ON b.feature = c.feature""")
def drift_zscore(spark, sf):
    base, cur = _periods(spark, sf)
    return D.drift_zscore(cur, base, FEATURES).select(rnd("drift_score").alias("drift_score"))


@query("drift_cv", f"""WITH c AS ({_stats_sql('true')})
SELECT round(coalesce(least(avg(CASE WHEN mean <> 0 THEN std / abs(mean) END) / 2, 1.0), 0.0), 6) AS drift_score FROM c""")
def drift_cv(spark, sf):
    return D.drift_cv(views.txn(spark, sf).select(*FEATURES), FEATURES).select(rnd("drift_score").alias("drift_score"))


@query("anomaly_zscore", "WITH b AS (SELECT " + ", ".join(
    f"avg({_Q(c)}) AS m_{c}, stddev_pop({_Q(c)}) AS s_{c}" for c in FEATURES) + f' FROM txn WHERE "Time" < {_SPLIT}), '
    "x AS (SELECT event_id, (" + " + ".join(
        f"(CASE WHEN s_{c} > 0 THEN abs({_Q(c)} - m_{c}) / s_{c} ELSE 0.0 END)" for c in FEATURES)
    + f') / 30 AS sc FROM txn, b WHERE "Time" >= {_SPLIT}) '
    "SELECT event_id, round(sc, 6) AS anomaly_score, sc > 3.0 AS is_anomaly FROM x")
def anomaly_zscore(spark, sf):
    base, cur = _periods(spark, sf)
    r = D.anomaly_zscore(cur, base, FEATURES, "event_id")
    return r.select("event_id", rnd("anomaly_score").alias("anomaly_score"), "is_anomaly")


_IQR_SQL = "q AS (SELECT " + ", ".join(
    f"quantile_cont({_Q(c)}, 0.25) AS a_{c}, quantile_cont({_Q(c)}, 0.75) AS b_{c}" for c in FEATURES) + " FROM txn), " + \
    "x AS (SELECT event_id, " + " + ".join(
        f"CAST(({_Q(c)} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {_Q(c)} > b_{c} + 1.5 * (b_{c} - a_{c})) AS INTEGER)" for c in FEATURES) + \
    " AS n_features_out FROM txn, q)"


@query("anomaly_iqr", f"WITH {_IQR_SQL} SELECT event_id, n_features_out FROM x WHERE n_features_out > 0")
def anomaly_iqr(spark, sf):
    t = views.txn(spark, sf).select("event_id", *FEATURES)
    return D.anomaly_iqr(t, FEATURES, "event_id")


@query("anomaly_union", f"WITH {_IQR_SQL} SELECT count(*) AS anomaly_count FROM x WHERE n_features_out > 0")
def anomaly_union(spark, sf):
    """Rows out of bounds in any feature, each row counted once."""
    t = views.txn(spark, sf).select("event_id", *FEATURES)
    return D.anomaly_iqr(t, FEATURES, "event_id").agg(F.count(F.lit(1)).alias("anomaly_count"))


def _importance(df):
    long = df.select("Class", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                                  for c in FEATURES])).alias("kv")).select("Class", "kv.*")
    g = long.groupBy("feature").agg(F.avg(F.when(F.col("Class") == 1, F.col("v"))).alias("f"),
                                    F.avg(F.when(F.col("Class") != 1, F.col("v"))).alias("n"), F.stddev_pop("v").alias("s"))
    return g.select("feature", F.coalesce(F.abs(F.col("f") - F.col("n")) / F.col("s"), F.lit(0.0)).alias("importance"))


def _imp_sql(where):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(abs(avg({_Q(c)}) FILTER (WHERE Class = 1) - avg({_Q(c)}) FILTER (WHERE Class <> 1)) / stddev_pop({_Q(c)}), 0.0) AS importance FROM txn WHERE {where}"
        for c in FEATURES)


@query("importance_drift", f"""WITH b AS ({_imp_sql(f'"Time" < {_SPLIT}')}), c AS ({_imp_sql(f'"Time" >= {_SPLIT}')}),
j AS (SELECT b.feature, b.importance AS ib, coalesce(c.importance, 0.0) AS ic FROM b LEFT JOIN c ON b.feature = c.feature),
n AS (SELECT *, CASE WHEN sum(ic) OVER () > 0 THEN ic / sum(ic) OVER () ELSE ic END + 1e-10 AS p,
             CASE WHEN sum(ib) OVER () > 0 THEN ib / sum(ib) OVER () ELSE ib END + 1e-10 AS q FROM j)
SELECT round(coalesce(sum(p * ln(p / q)), 0.0), 6) AS importance_drift FROM n""")
def importance_drift(spark, sf):
    """KL divergence of the current vs baseline feature-importance distribution
    (importance = |mean_fraud - mean_normal| / std per period)."""
    base, cur = _periods(spark, sf)
    return D.importance_drift(_importance(cur), _importance(base)).select(rnd("importance_drift").alias("importance_drift"))
