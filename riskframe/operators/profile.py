"""Dataset profiles, data-quality issues and feature statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import codes, safe_div, unpivot
from riskframe.functions.quantiles import quantiles


def dataset_profile(df: DataFrame, label: str = "Class") -> DataFrame:
    """Rows, columns, positives, positive rate (one aggregate)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.col(label).cast("long")).alias("positives")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "positives",
        safe_div(F.col("positives"), F.col("rows")).alias("positive_rate"))


def dataset_issues(df: DataFrame, features: list[str], label: str = "Class",
                   amount: str = "Amount", time: str = "Time") -> DataFrame:
    """One row per data-quality issue (code) found in a single aggregation pass."""
    cols = features + [label]
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))
    infs = sum((F.sum(F.col(c).isin(float("inf"), float("-inf")).cast("long")) for c in features), F.lit(0))
    a = df.agg(nulls.alias("n_null"), infs.alias("n_inf"), F.avg(F.col(label).cast("double")).alias("rate"),
               F.min(amount).alias("min_amount"), F.min(time).alias("min_time"))
    found = codes((F.col("n_null") > 0, "missing_values"),
                  (F.col("rate") == 0, "no_positive_class"),
                  (F.col("rate") > 0.1, "positive_rate_high"),
                  (F.col("min_amount") <= 0, "non_positive_amount"),
                  (F.col("min_time") < 0, "negative_time"),
                  (F.col("n_inf") > 0, "infinite_values"))
    return a.select(F.explode(found).alias("issue"), "n_null", "n_inf",
                    "rate", "min_amount", "min_time")


def feature_distributions(df: DataFrame, features: list[str], label: str = "Class",
                          quantile_method: str = "exact") -> DataFrame:
    """Per feature mean, sample std, min, max, median, q25, q75 and the mean / sample
    std within each class.  Long form + one groupBy; quantiles distributed."""
    long = df.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features
    ])).alias("kv")).select(label, "kv.feature", "kv.value")
    pos = F.col(label) == 1
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.when(pos, F.col("value"))).alias("fraud_mean"),
        F.stddev_samp(F.when(pos, F.col("value"))).alias("fraud_std"),
        F.avg(F.when(~pos, F.col("value"))).alias("normal_mean"),
        F.stddev_samp(F.when(~pos, F.col("value"))).alias("normal_std"))
    q = quantiles(long, "feature", "value", {"q25": 0.25, "median": 0.5, "q75": 0.75},
                  method=quantile_method)
    return stats.join(q, "feature")


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every feature pair, long form (f_i, f_j, corr), full
    matrix incl. diagonal.  Pairwise: a row with a null in a third column still counts."""
    names = F.array(*[F.lit(c) for c in features])
    return pairwise_correlations(df, features).select(
        names[F.col("i")].alias("f_i"), names[F.col("j")].alias("f_j"),
        F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("r")).alias("corr"))


def _pair_moments(width: int):
    """Per task and pair of columns (i, j), over the rows that hold both: their number, the two means, i's squared and both's crossed deviations."""
    def run(batches):
        n, mean, square, cross = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            there = np.stack([np.asarray(c.is_valid()) for c in batch.columns], 1).astype(float)
            x = np.stack([np.asarray(c.fill_null(0.0), dtype=float) for c in batch.columns], 1)
            shift = x.sum(0) / np.maximum(there.sum(0), 1)
            x = (x - shift) * there
            m = there.T @ there
            some = np.maximum(m, 1)
            sums = x.T @ there
            new_mean = sums / some
            new_square = (x * x).T @ there - sums * new_mean
            new_cross = x.T @ x - sums * sums.T / some
            new_mean = new_mean + shift[:, None]
            both = np.maximum(n + m, 1)
            apart = new_mean - mean
            weight = n * m / both
            square += new_square + weight * apart * apart
            cross += new_cross + weight * apart * apart.T
            mean += apart * m / both
            n += m
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(v) for v in (n[i, j], mean[i, j], mean[j, i], square[i, j], square[j, i], cross[i, j])]],
                                         ["i", "j", "n", "mi", "mj", "si", "sj", "c"])
    return run


def pairwise_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, r) for all ordered pairs of columns by number; each pair over the rows where
    both are present, null where either is constant there or no row holds both.

    A task adds up its rows by matrix products and sends one row per pair; the tasks' means
    and deviations are then merged pair by pair.
    """
    k = len(cols)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = x.mapInArrow(_pair_moments(k), "i int, j int, n double, mi double, mj double, si double, sj double, c double")
    pair = Window.partitionBy("i", "j")
    whole = lambda m: F.sum(F.col("n") * F.col(m)).over(pair) / F.sum("n").over(pair)
    near = parts.select("*", (F.col("mi") - whole("mi")).alias("di"), (F.col("mj") - whole("mj")).alias("dj"))
    grown = lambda s, a, b: F.sum(F.col(s) + F.col("n") * F.col(a) * F.col(b))
    sums = near.groupBy("i", "j").agg(grown("si", "di", "di").alias("si"), grown("sj", "dj", "dj").alias("sj"), grown("c", "di", "dj").alias("c"))
    grid = df.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    return grid.join(sums, ["i", "j"], "left").select("i", "j", F.try_divide("c", F.sqrt(F.col("si") * F.col("sj"))).alias("r"))


def baseline_stats(df: DataFrame, features: list[str], quantile_method: str = "exact") -> DataFrame:
    """Per feature mean, population std, min, max, quartiles, biased skewness and
    excess kurtosis (Spark's ``skewness`` / ``kurtosis`` are the biased forms)."""
    long = unpivot(df, features)
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    q = quantiles(long, "feature", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75},
                  method=quantile_method)
    return stats.join(q, "feature")


def prediction_distribution(scored: DataFrame, pred: str = "pred", p: str = "p") -> DataFrame:
    """One row per predicted class: count, share, mean/std of predictions overall,
    and confidence = max(p, 1-p) statistics (mean, std, #<0.6, #>0.9)."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    overall = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(pred).cast("double")).alias("pred_mean"),
                         F.stddev_pop(F.col(pred).cast("double")).alias("pred_std"),
                         F.avg(conf).alias("conf_mean"), F.stddev_pop(conf).alias("conf_std"),
                         F.sum((conf < 0.6).cast("long")).alias("low_conf"),
                         F.sum((conf > 0.9).cast("long")).alias("high_conf"))
    per = scored.groupBy(pred).agg(F.count(F.lit(1)).alias("class_count"))
    # overall is one row: bound once as a scalar column, no cross join
    o = F.col("_o")
    return per.withColumn("_o", overall.select(F.struct(*overall.columns)).scalar()).select(pred, "class_count", (F.col("class_count") * 100.0 / o["n"]).alias("class_pct"),
                      *[o[c].alias(c) for c in ["pred_mean", "pred_std", "conf_mean", "conf_std",
                                                "low_conf", "high_conf"]])


def confidence_bands(scored: DataFrame, p: str = "p") -> DataFrame:
    """Share of p in [0, .3), [.3, .7), [.7, 1]."""
    x = F.col(p)
    return scored.agg(F.avg(((x >= 0) & (x < 0.3)).cast("double")).alias("low_share"),
                      F.avg(((x >= 0.3) & (x < 0.7)).cast("double")).alias("medium_share"),
                      F.avg(((x >= 0.7) & (x <= 1.0)).cast("double")).alias("high_share"))


def rate_metrics(scored: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Fraud rate and predicted-fraud rate."""
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("fraud_rate"),
                      F.avg(F.col(pred).cast("double")).alias("predicted_rate"))
