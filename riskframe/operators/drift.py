"""Drift and anomaly detection against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import unpivot
from riskframe.functions.quantiles import quantiles


def _stats(df: DataFrame, cols: list[str]) -> DataFrame:
    long = unpivot(df, cols)
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def drift_zscore(current: DataFrame, baseline: DataFrame, cols: list[str]) -> DataFrame:
    """Mean over features of min(|mean_cur - mean_base| / std_base / 3, 1); std 0 -> 0."""
    b = _stats(baseline, cols).withColumnRenamed("mean", "mb").withColumnRenamed("std", "sb")
    c = _stats(current, cols).select("feature", F.col("mean").alias("mc"))
    j = b.join(c, "feature")
    s = F.when(F.col("sb") > 0, F.least(F.abs(F.col("mc") - F.col("mb")) / F.col("sb") / 3, F.lit(1.0))).otherwise(0.0)
    return j.agg(F.avg(s).alias("drift_score"))


def drift_cv(current: DataFrame, cols: list[str]) -> DataFrame:
    """No baseline: mean(std / |mean|) over features with mean != 0, / 2, capped at 1."""
    s = _stats(current, cols)
    cv = F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean")))
    return s.agg(F.coalesce(F.least(F.avg(cv) / 2, F.lit(1.0)), F.lit(0.0)).alias("drift_score"))


def anomaly_zscore(current: DataFrame, baseline: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """Row score = sum |z| / #features against the baseline (std 0 contributes 0);
    anomaly if > 3.  Baseline stats bound once as a struct scalar: row-local, no join."""
    st = baseline.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                    for c in cols])).scalar()
    x = current.withColumn("_st", st)
    terms = [F.when(F.col("_st")[c]["s"] > 0, F.abs(F.col(c) - F.col("_st")[c]["m"]) / F.col("_st")[c]["s"])
             .otherwise(F.lit(0.0)) for c in cols]
    score = sum(terms[1:], terms[0]) / len(cols)
    return x.select(id_col, score.alias("anomaly_score")).withColumn("is_anomaly", F.col("anomaly_score") > 3.0)


def anomaly_iqr(df: DataFrame, cols: list[str], id_col: str, method: str = "exact") -> DataFrame:
    """Rows outside [q1 - 1.5 iqr, q3 + 1.5 iqr] in any feature, each row once,
    with the number of features out of range.  Quartiles are distributed exact quantiles."""
    q = quantiles(unpivot(df, cols), "feature", "value", {"q1": 0.25, "q3": 0.75}, method=method)
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).alias("i")
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select(place, (F.col("q1") - 1.5 * iqr).alias("low"), (F.col("q3") + 1.5 * iqr).alias("high")) \
        .agg(F.sort_array(F.collect_list(F.struct("i", "low", "high")))).scalar()
    # The bounds stand once, as an array beside the array of values.
    out = F.filter(F.arrays_zip(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"), F.col("_bounds").alias("b")),
                   lambda e: (e["v"] < e["b"]["low"]) | (e["v"] > e["b"]["high"]))
    return df.withColumn("_bounds", bounds).select(id_col, F.size(out).alias("n_features_out")).filter(F.col("n_features_out") > 0)


def importance_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """KL(current || baseline) of two (feature, importance) tables, each normalised then
    + 1e-10; keys from the baseline (absent current -> 0); empty baseline -> 0."""
    b = baseline.select("feature", F.col("importance").alias("ib"))
    c = current.select("feature", F.col("importance").alias("ic"))
    j = b.join(c, "feature", "left").na.fill(0.0, ["ic"])
    sums = j.select(F.struct(F.sum("ib").alias("sb"), F.sum("ic").alias("sc"))).scalar()
    j = j.withColumn("_s", sums)
    p = F.when(F.col("_s.sc") > 0, F.col("ic") / F.col("_s.sc")).otherwise(F.col("ic")) + 1e-10
    q = F.when(F.col("_s.sb") > 0, F.col("ib") / F.col("_s.sb")).otherwise(F.col("ib")) + 1e-10
    return j.agg(F.coalesce(F.sum(p * F.log(p / q)), F.lit(0.0)).alias("importance_drift"))
