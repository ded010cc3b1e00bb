"""Catalog: classification metrics and model ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import metrics as M
from riskframe.plans.catalog import query
from riskframe.sources import views

_COUNTS = """SELECT model, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
  sum(CASE WHEN y <> 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN y = 1 AND pred <> 1 THEN 1 ELSE 0 END)::BIGINT AS fn,
  sum(CASE WHEN y <> 1 AND pred <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn FROM model_scores GROUP BY model"""

_POINT = """coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1"""


def _r(df, cols, d=9):
    return df.select(*[rnd(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("confusion_matrix", f"""
WITH c AS ({_COUNTS})
SELECT model, CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
  CASE WHEN a = 0 AND p = 0 THEN tn WHEN a = 0 THEN fp WHEN p = 0 THEN fn ELSE tp END AS count
FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(a, p)""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(views.model_scores(spark, sf), groups=["model"])


@query("point_metrics", f"""WITH c AS ({_COUNTS}) SELECT model, tp, fp, fn, tn,
  round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0), 9) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 9) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1 FROM c""")
def point_metrics(spark, sf):
    r = M.point_metrics(views.model_scores(spark, sf), groups=["model"])
    return _r(r, ["accuracy", "precision", "recall", "f1"])


@query("classification_report", f"""
WITH c AS ({_COUNTS}),
k AS (SELECT model, tp, fp, fn, tn,
  coalesce(tn / nullif(tn + fn, 0), 0.0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0.0) AS r0,
  coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0) AS f0,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r1,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, tn + fp AS s0, tp + fn AS s1 FROM c)
SELECT model, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT model, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM k UNION ALL
  SELECT model, '1', p1, r1, f1, s1 FROM k UNION ALL
  SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM k UNION ALL
  SELECT model, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
         (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM k)""")
def classification_report(spark, sf):
    r = M.classification_report(views.model_scores(spark, sf), groups=["model"])
    return _r(r, ["precision", "recall", "f1"])


_SCORES = """s AS (SELECT model, p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM model_scores GROUP BY model, p),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score) AS cum_pos,
             sum(neg) OVER (PARTITION BY model ORDER BY score) AS cum_neg,
             sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N",
             count(*) OVER (PARTITION BY model) AS ns FROM s)"""


@query("roc_auc", f"""WITH {_SCORES}
SELECT model, round(CASE WHEN "P" = 0 OR "N" = 0 OR ns < 2 THEN 0.5
  ELSE sum(pos * ((cum_neg - neg) + neg * 0.5)) / ("P" * "N") END, 9) AS roc_auc
FROM c GROUP BY model, "P", "N", ns""")
def roc_auc(spark, sf):
    return _r(M.roc_auc(views.model_scores(spark, sf), groups=["model"]), ["roc_auc"])


@query("average_precision", f"""WITH {_SCORES}
SELECT model, round(CASE WHEN "P" = 0 OR "N" = 0 OR ns < 2 THEN "P" / ("P" + "N")
  ELSE sum(pos / "P" * (("P" - (cum_pos - pos)) / (("P" - (cum_pos - pos)) + ("N" - (cum_neg - neg))))) END, 9) AS average_precision
FROM c GROUP BY model, "P", "N", ns""")
def average_precision(spark, sf):
    return _r(M.average_precision(views.model_scores(spark, sf), groups=["model"]), ["average_precision"])


@query("roc_curve", f"""WITH {_SCORES}
SELECT model, score AS threshold, round(("N" - (cum_neg - neg)) / "N", 9) AS fpr,
  round(("P" - (cum_pos - pos)) / "P", 9) AS tpr FROM c""")
def roc_curve(spark, sf):
    return _r(M.roc_curve(views.model_scores(spark, sf), groups=["model"]), ["fpr", "tpr"])


@query("pr_curve", f"""WITH {_SCORES}
SELECT model, score AS threshold,
  round(("P" - (cum_pos - pos)) / (("P" - (cum_pos - pos)) + ("N" - (cum_neg - neg))), 9) AS precision,
  round(("P" - (cum_pos - pos)) / "P", 9) AS recall FROM c""")
def pr_curve(spark, sf):
    return _r(M.pr_curve(views.model_scores(spark, sf), groups=["model"]), ["precision", "recall"])


_EVAL_SQL = f"""
WITH {_SCORES},
auc AS (SELECT model, CASE WHEN "P" = 0 OR "N" = 0 OR ns < 2 THEN 0.5
  ELSE sum(pos * ((cum_neg - neg) + neg * 0.5)) / ("P" * "N") END AS roc_auc,
  CASE WHEN "P" = 0 OR "N" = 0 OR ns < 2 THEN "P" / ("P" + "N")
  ELSE sum(pos / "P" * (("P" - (cum_pos - pos)) / (("P" - (cum_pos - pos)) + ("N" - (cum_neg - neg))))) END AS average_precision
  FROM c GROUP BY model, "P", "N", ns),
k AS ({_COUNTS}),
ev AS (SELECT k.model, tp, fp, fn, tn, {_POINT}, tp + fp + fn + tn AS n,
  (tp + fn) / (tp + fp + fn + tn) AS fraud_rate, (tp + fp) / (tp + fp + fn + tn) AS predicted_rate,
  roc_auc, average_precision FROM k JOIN auc ON k.model = auc.model)"""


@query("evaluation_record", _EVAL_SQL + """
SELECT model, tp, fp, fn, tn, n, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision,
  round(recall, 9) AS recall, round(f1, 9) AS f1, round(fraud_rate, 9) AS fraud_rate,
  round(predicted_rate, 9) AS predicted_rate, round(roc_auc, 9) AS roc_auc,
  round(average_precision, 9) AS average_precision FROM ev""")
def evaluation_record(spark, sf):
    r = M.evaluation_record(views.model_scores(spark, sf), groups=["model"])
    return _r(r.select("model", "tp", "fp", "fn", "tn", "n", "accuracy", "precision", "recall", "f1",
                       "fraud_rate", "predicted_rate", "roc_auc", "average_precision"),
              ["accuracy", "precision", "recall", "f1", "fraud_rate", "predicted_rate", "roc_auc",
               "average_precision"])


@query("cv_summary", """
WITH sc AS (SELECT m.model, f.fold, m.y, m.pred, m.p FROM model_scores m JOIN folds f ON m.event_id = f.event_id),
parts AS (
  SELECT model, fold AS k, 'test' AS part, y, pred, p FROM sc
  UNION ALL
  SELECT sc.model, fk.k, 'train', y, pred, p FROM sc JOIN (SELECT DISTINCT fold AS k FROM folds) fk ON sc.fold <> fk.k),
cnt AS (SELECT model, k, part, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y <> 1 AND pred <> 1 THEN 1 ELSE 0 END) AS tn FROM parts GROUP BY ALL),
s AS (SELECT model, k, part, p AS score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM parts GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY model, k, part ORDER BY score) AS cum_neg,
  sum(pos) OVER (PARTITION BY model, k, part) AS "P", sum(neg) OVER (PARTITION BY model, k, part) AS "N",
  count(*) OVER (PARTITION BY model, k, part) AS ns FROM s),
auc AS (SELECT model, k, part, CASE WHEN "P" = 0 OR "N" = 0 OR ns < 2 THEN 0.5
  ELSE sum(pos * ((cum_neg - neg) + neg * 0.5)) / ("P" * "N") END AS roc_auc FROM c GROUP BY model, k, part, "P", "N", ns),
m AS (SELECT cnt.model, cnt.part, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, roc_auc
  FROM cnt JOIN auc ON cnt.model = auc.model AND cnt.k = auc.k AND cnt.part = auc.part),
long AS (UNPIVOT m ON accuracy, precision, recall, f1, roc_auc INTO NAME metric VALUE value)
SELECT model, metric, round(avg(value) FILTER (WHERE part = 'test'), 9) AS test_mean,
  round(stddev_pop(value) FILTER (WHERE part = 'test'), 9) AS test_std,
  round(avg(value) FILTER (WHERE part = 'train'), 9) AS train_mean FROM long GROUP BY model, metric""")
def cv_summary(spark, sf):
    ms = views.model_scores(spark, sf)
    f = views.folds(spark, sf).select("event_id", "fold")
    r = M.cv_summary(ms.join(f, "event_id"))
    return _r(r, ["test_mean", "test_std", "train_mean"])


@query("rank_models", _EVAL_SQL + """
SELECT model, round(coalesce(roc_auc, 0), 9) AS metric_value,
  CAST(rank() OVER (ORDER BY coalesce(roc_auc, 0) DESC) AS INTEGER) AS rank FROM ev""")
def rank_models(spark, sf, metric: str = "roc_auc"):
    """Order models by a chosen metric (absent -> 0); a models-sized window."""
    ev = M.evaluation_record(views.model_scores(spark, sf), groups=["model"])
    v = F.coalesce(F.col(metric), F.lit(0.0))
    return ev.select("model", rnd(v, 9).alias("metric_value"),
                     F.rank().over(Window.orderBy(v.desc())).cast("int").alias("rank"))


@query("composite_rank", _EVAL_SQL + """
SELECT model, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'success' WHEN score >= 80 THEN 'primary'
  WHEN score >= 70 THEN 'warning' ELSE 'secondary' END AS grade,
  CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS position FROM (
  SELECT model, (coalesce(roc_auc, 0) * 0.4 + coalesce(f1, 0) * 0.3 + coalesce(precision, 0) * 0.2
                 + coalesce(recall, 0) * 0.1) * 100 AS score FROM ev)""")
def composite_rank(spark, sf):
    """100 * (0.4 AUC + 0.3 F1 + 0.2 precision + 0.1 recall) and its badge band."""
    ev = M.evaluation_record(views.model_scores(spark, sf), groups=["model"])
    sc = (F.coalesce(F.col("roc_auc"), F.lit(0.0)) * 0.4 + F.coalesce(F.col("f1"), F.lit(0.0)) * 0.3
          + F.coalesce(F.col("precision"), F.lit(0.0)) * 0.2 + F.coalesce(F.col("recall"), F.lit(0.0)) * 0.1) * 100
    x = ev.select("model", sc.alias("score"))
    grade = (F.when(F.col("score") >= 90, "success").when(F.col("score") >= 80, "primary")
             .when(F.col("score") >= 70, "warning").otherwise("secondary"))
    return x.select("model", rnd("score", 6).alias("score"), grade.alias("grade"),
                    F.row_number().over(Window.orderBy(F.col("score").desc(), "model")).cast("int").alias("position"))


@query("best_model", _EVAL_SQL + """
SELECT arg_max(model, average_precision) AS best_model, round(max(average_precision), 9) AS best_average_precision,
  arg_max(model, roc_auc) FILTER (WHERE roc_auc > 0) AS best_auc_model FROM ev""")
def best_model(spark, sf):
    """Model with max average precision (and the max-AUC variant)."""
    ev = M.evaluation_record(views.model_scores(spark, sf), groups=["model"])
    return ev.agg(F.max_by("model", "average_precision").alias("best_model"),
                  rnd(F.max("average_precision"), 9).alias("best_average_precision"),
                  F.max_by(F.when(F.col("roc_auc") > 0, F.col("model")), F.when(F.col("roc_auc") > 0, F.col("roc_auc")))
                  .alias("best_auc_model"))
