"""Exact classification metrics on scored tables.

All metrics take an optional list of group columns (e.g. ``model``) so one pass serves
many models.  Curve metrics (AUC, AP, ROC/PR curves) first collapse rows to one row per
distinct (group, score) — a map-side-combined aggregate — and run their running sums per
score bucket (``global_cumsum``), never as one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import safe_div
from riskframe.functions.ranking import global_cumsum, depth_bucket


def _counts(df: DataFrame, y: str, pred: str, groups: list[str]) -> DataFrame:
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*groups).agg(
        F.sum((yy & pp).cast("long")).alias("tp"), F.sum((~yy & pp).cast("long")).alias("fp"),
        F.sum((yy & ~pp).cast("long")).alias("fn"), F.sum((~yy & ~pp).cast("long")).alias("tn"))


def point_from_counts(c: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from tp/fp/fn/tn columns; zero division -> 0."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = safe_div(tp, tp + fp)
    rec = safe_div(tp, tp + fn)
    return c.withColumn("accuracy", safe_div(tp + tn, tp + fp + fn + tn)) \
        .withColumn("precision", prec).withColumn("recall", rec) \
        .withColumn("f1", safe_div(2 * tp, 2 * tp + fp + fn))


def point_metrics(df: DataFrame, y: str = "y", pred: str = "pred", groups: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0)."""
    return point_from_counts(_counts(df, y, pred, list(groups or [])))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred", groups: list[str] | None = None) -> DataFrame:
    """2x2 counts, zero-filled (the 4 cells come from one conditional aggregate)."""
    g = list(groups or [])
    c = _counts(df, y, pred, g)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("count"))
                      for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*g, F.explode(cells).alias("c")).select(*g, "c.actual", "c.predicted", "c.count")


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred",
                          groups: list[str] | None = None) -> DataFrame:
    """Per class precision/recall/f1/support + macro and weighted averages."""
    g = list(groups or [])
    c = _counts(df, y, pred, g)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))

    def prf(t, f_p, f_n):
        p, r = safe_div(t, t + f_p), safe_div(t, t + f_n)
        return p, r, safe_div(2 * t, 2 * t + f_p + f_n)

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), safe_div(p0 * s0 + p1 * s1, n).alias("precision"),
                 safe_div(r0 * s0 + r1 * s1, n).alias("recall"), safe_div(f0 * s0 + f1 * s1, n).alias("f1"),
                 n.alias("support")))
    return c.select(*g, F.explode(rows).alias("r")).select(*g, "r.*")


def score_table(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None,
                bucket: Column | None = None) -> DataFrame:
    """One row per distinct (group, score): pos, neg, and inclusive running counts in
    ascending score order (cum_pos, cum_neg) plus group totals P, N."""
    g = list(groups or [])
    s = df.groupBy(*g, F.col(p).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    if bucket is None:
        s, bucket = depth_bucket(s, "score"), F.col("_depth")
    c = global_cumsum(s, "score", bucket, ["pos", "neg"], partition_by=g).drop("_depth")
    tot = s.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                            F.count(F.lit(1)).alias("n_scores"))
    return c.join(tot, g)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None) -> DataFrame:
    """Tie-aware ROC-AUC (average ranks); single class or constant score -> 0.5."""
    if not groups:
        return roc_auc(df.withColumn("_g", F.lit(0)), y, p, ["_g"]).drop("_g")
    g = list(groups or [])
    return _areas(score_table(df, y, p, g), g).select(*g, "roc_auc")


def _areas(t: DataFrame, g: list[str]) -> DataFrame:
    """ROC-AUC and average precision of a score table, in one aggregate."""
    rank = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") * 0.5)
    tp_ge = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    fp_ge = F.col("N") - (F.col("cum_neg") - F.col("neg"))
    step = F.try_divide(F.col("pos"), F.col("P")) * F.try_divide(tp_ge, tp_ge + fp_ge)
    a = t.groupBy(*g).agg(F.sum(rank).alias("_s"), F.sum(step).alias("_ap"), F.first("P").alias("P"), F.first("N").alias("N"),
                          F.first("n_scores").alias("n_scores"))
    flat = (F.col("P") == 0) | (F.col("N") == 0) | (F.col("n_scores") < 2)
    return a.select(*g, F.when(flat, F.lit(0.5)).otherwise(F.try_divide(F.col("_s"), F.col("P") * F.col("N"))).alias("roc_auc"),
                    F.when(flat, safe_div(F.col("P"), F.col("P") + F.col("N"))).otherwise(F.col("_ap")).alias("average_precision"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None) -> DataFrame:
    """Step-wise AP = sum over distinct thresholds of (R_k - R_k-1) * P_k; degenerate
    (single class / constant score) -> base rate."""
    if not groups:
        return average_precision(df.withColumn("_g", F.lit(0)), y, p, ["_g"]).drop("_g")
    g = list(groups or [])
    return _areas(score_table(df, y, p, g), g).select(*g, "average_precision")


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None) -> DataFrame:
    """Fpr, tpr at every distinct score used as threshold (score >= threshold)."""
    if not groups:
        return roc_curve(df.withColumn("_g", F.lit(0)), y, p, ["_g"]).drop("_g")
    g = list(groups or [])
    t = score_table(df, y, p, g)
    tp_ge = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    fp_ge = F.col("N") - (F.col("cum_neg") - F.col("neg"))
    return t.select(*g, F.col("score").alias("threshold"), safe_div(fp_ge, F.col("N")).alias("fpr"),
                    safe_div(tp_ge, F.col("P")).alias("tpr"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", groups: list[str] | None = None) -> DataFrame:
    """Precision, recall at every distinct score used as threshold."""
    if not groups:
        return pr_curve(df.withColumn("_g", F.lit(0)), y, p, ["_g"]).drop("_g")
    g = list(groups or [])
    t = score_table(df, y, p, g)
    tp_ge = F.col("P") - (F.col("cum_pos") - F.col("pos"))
    fp_ge = F.col("N") - (F.col("cum_neg") - F.col("neg"))
    return t.select(*g, F.col("score").alias("threshold"), safe_div(tp_ge, tp_ge + fp_ge).alias("precision"),
                    safe_div(tp_ge, F.col("P")).alias("recall"))


def evaluation_record(df: DataFrame, y: str = "y", pred: str = "pred", p: str = "p",
                      groups: list[str] | None = None) -> DataFrame:
    """M01/M02 counts and metrics + AUC + AP + size, fraud rate, predicted rate per group."""
    g = list(groups or ["model"])
    c = point_from_counts(_counts(df, y, pred, g))
    c = c.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")) \
        .withColumn("fraud_rate", safe_div(F.col("tp") + F.col("fn"), F.col("n"))) \
        .withColumn("predicted_rate", safe_div(F.col("tp") + F.col("fp"), F.col("n")))
    return c.join(_areas(score_table(df, y, p, g), g), g)


def cv_summary(scored_folds: DataFrame, y: str = "y", pred: str = "pred", p: str = "p",
               model: str = "model", fold: str = "fold", k: int = 5) -> DataFrame:
    """Per model, mean and population std of each test-fold metric and mean of the
    train-fold metric, over folds 0 .. k - 1.

    One row per (model, score) carries the counts of every fold; one set of running sums
    serves all folds, and a fold's training counts are the total less the fold.
    """
    pos, neg, hit = F.col(y) == 1, F.col(y) != 1, F.col(pred) == 1
    kinds = {"pos": pos, "neg": neg, "tp": pos & hit, "fp": neg & hit}
    per = scored_folds.groupBy(model, F.col(p).alias("score")).agg(*[
        F.sum(((F.col(fold) == f) & c).cast("long")).alias(f"{n}{f}") for f in range(k) for n, c in kinds.items()])
    run = global_cumsum(depth_bucket(per, "score"), "score", F.col("_depth"), [f"neg{f}" for f in range(k)], partition_by=[model])
    total = lambda n: sum((F.col(f"{n}{f}") for f in range(k)), F.lit(0))

    def part(f: int, test: bool):
        c = lambda n: F.col(f"{n}{f}") if test else total(n) - F.col(f"{n}{f}")
        below = c("cum_neg") - c("neg")
        return F.struct(*[F.sum(c(n)).alias(n) for n in kinds], F.sum(c("pos") * (below + c("neg") * 0.5)).alias("s"),
                        F.sum((c("pos") + c("neg") > 0).cast("long")).alias("scores"), F.lit(test).alias("test"))
    parts = run.groupBy(model).agg(F.array(*[part(f, t) for f in range(k) for t in (True, False)]).alias("parts"))
    c = parts.select(model, F.explode("parts").alias("x")).select(model, "x.*").where("pos + neg > 0")
    m = point_from_counts(c.withColumn("fn", F.col("pos") - F.col("tp")).withColumn("tn", F.col("neg") - F.col("fp")))
    m = m.withColumn("roc_auc", F.when((F.col("pos") == 0) | (F.col("neg") == 0) | (F.col("scores") < 2), F.lit(0.5))
                     .otherwise(F.try_divide(F.col("s"), F.col("pos") * F.col("neg"))))
    long = m.select(model, "test", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in ("accuracy", "precision", "recall", "f1", "roc_auc")])).alias("kv")).select(model, "test", "kv.*")
    return long.groupBy(model, "metric").agg(
        F.avg(F.when(F.col("test"), F.col("value"))).alias("test_mean"),
        F.stddev_pop(F.when(F.col("test"), F.col("value"))).alias("test_std"),
        F.avg(F.when(~F.col("test"), F.col("value"))).alias("train_mean"))
