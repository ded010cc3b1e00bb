"""Feature engineering and scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import safe_div
from riskframe.functions.quantiles import quantiles


def time_features(df: DataFrame, time: str = "Time") -> DataFrame:
    """Hour = Time/3600 mod 24 (fractional), Day = Time/86400 mod 7, sin/cos of Hour."""
    hour = F.pmod(F.col(time) / 3600, F.lit(24.0))
    return df.withColumn("Hour", hour).withColumn("Day", F.pmod(F.col(time) / 86400, F.lit(7.0))) \
        .withColumn("Time_sin", F.sin(F.lit(2 * math.pi) * F.col("Hour") / 24)) \
        .withColumn("Time_cos", F.cos(F.lit(2 * math.pi) * F.col("Hour") / 24))


def amount_features(df: DataFrame, amount: str = "Amount") -> DataFrame:
    """log1p and sqrt of Amount."""
    return df.withColumn("Amount_log", F.log1p(amount)).withColumn("Amount_sqrt", F.sqrt(amount))


def amount_bins(df: DataFrame, amount: str = "Amount", bins: int = 10) -> DataFrame:
    """Equal-width, right-closed bins over the observed min..max; min -> bin 0.
    min/max come from one scalar-subquery aggregate (no join)."""
    mm = df.select(F.struct(F.min(amount).alias("lo"), F.max(amount).alias("hi"))).scalar()
    lo, hi = F.col("_mm")["lo"], F.col("_mm")["hi"]
    w = (hi - lo) / F.lit(float(bins))
    b = F.greatest(F.ceil(F.try_divide(F.col(amount) - lo, w)) - 1, F.lit(0))
    return df.withColumn("_mm", mm).withColumn("Amount_bin", F.least(b, F.lit(bins - 1)).cast("int")).drop("_mm")


def interactions(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise products of V1..V5 (10 columns)."""
    cols = cols or [f"V{i}" for i in range(1, 6)]
    out = df
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            out = out.withColumn(f"{a}_{b}_interaction", F.col(a) * F.col(b))
    return out


def time_context(df: DataFrame, time: str = "Time") -> DataFrame:
    """Integer hour, day of week, weekend = day >= 5."""
    return df.withColumn("hour_of_day", F.floor(F.pmod(F.col(time) / 3600, F.lit(24.0))).cast("int")) \
        .withColumn("day_of_week", F.floor(F.pmod(F.col(time) / 86400, F.lit(7.0))).cast("int")) \
        .withColumn("is_weekend", F.col("day_of_week") >= 5)


def merchant_by_amount(amount: Column) -> Column:
    """<50 grocery, <200 restaurant, <500 department_store, else online."""
    return (F.when(amount < 50, "grocery").when(amount < 200, "restaurant")
            .when(amount < 500, "department_store").otherwise("online"))


def location_bucket(df: DataFrame) -> Column:
    """Mean |V1,V2,V3,V14| -> <.5 normal, <1 slightly, <2 highly, else foreign."""
    s = (F.abs(df["V1"]) + F.abs(df["V2"]) + F.abs(df["V3"]) + F.abs(df["V14"])) / 4
    return (F.when(s < 0.5, "normal").when(s < 1.0, "slightly_unusual")
            .when(s < 2.0, "highly_unusual").otherwise("foreign"))


def spending_bucket(df: DataFrame, amount: str = "Amount") -> Column:
    """Mean |V4,V11,V12| + log1p(Amount)/10 -> <1, <2, <3, else."""
    s = (F.abs(df["V4"]) + F.abs(df["V11"]) + F.abs(df["V12"])) / 3 + F.log1p(df[amount]) / 10
    return (F.when(s < 1.0, "typical").when(s < 2.0, "slightly_higher")
            .when(s < 3.0, "much_higher").otherwise("suspicious"))


def label_clusters(df: DataFrame, cluster: str = "cluster", amount: str = "Amount",
                   label: str = "Class") -> DataFrame:
    """Per cluster mean amount and fraud rate -> merchant category (one groupBy)."""
    g = df.groupBy(cluster).agg(F.avg(amount).alias("avg_amount"),
                                F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    a, r = F.col("avg_amount"), F.col("fraud_rate")
    cat = (F.when(a < 50, F.when(r > 0.005, "atm").otherwise("grocery"))
           .when(a < 200, F.when(r > 0.003, "gas").otherwise("restaurant"))
           .when(a < 500, "department_store").when(a < 1000, "online")
           .otherwise(F.when(r > 0.01, "travel").otherwise("entertainment")))
    return g.withColumn("merchant_category", cat)


def mapping_training_set(df: DataFrame) -> DataFrame:
    """Derived business fields + ordinals for every transaction (E05-E08 + P05)."""
    from riskframe.operators.align import encode_ordinals
    x = time_context(df)
    x = x.withColumn("transaction_amount", F.col("Amount")) \
        .withColumn("merchant_category", merchant_by_amount(F.col("Amount"))) \
        .withColumn("location_risk", location_bucket(x)) \
        .withColumn("spending_pattern", spending_bucket(x))
    return encode_ordinals(x)


# ---- scalers: fit = one aggregate row (scalar subquery), apply = projection -------------

def fit_standard(train: DataFrame, cols: list[str]) -> Column:
    """E12 fit: struct of (mean, population std with 0 -> 1) per column."""
    return train.select(F.struct(*[
        F.struct(F.avg(c).alias("mu"),
                 F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias("sd")).alias(c)
        for c in cols])).scalar()


def _bind(df: DataFrame, stats: Column) -> tuple[DataFrame, Column]:
    """Evaluate a stats scalar subquery once per query (one column), not once per use."""
    return df.withColumn("_st", stats), F.col("_st")


def scale_standard(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean_train) / std_pop_train for ``cols``."""
    d, s = _bind(df, fit_standard(train, cols))
    return d.select(*[c for c in df.columns if c not in cols],
                    *[((F.col(c) - s[c]["mu"]) / s[c]["sd"]).alias(c) for c in cols])


def scale_minmax(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column maps to 0."""
    d, s = _bind(df, train.select(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                                             for c in cols])).scalar())
    return d.select(*[c for c in df.columns if c not in cols], *[
        F.when(s[c]["hi"] == s[c]["lo"], F.lit(0.0))
        .otherwise((F.col(c) - s[c]["lo"]) / (s[c]["hi"] - s[c]["lo"])).alias(c) for c in cols])


def scale_robust(df: DataFrame, train: DataFrame, cols: list[str], method: str = "exact") -> DataFrame:
    """(x - median) / (q75 - q25), exact distributed quantiles of the train rows;
    zero IQR -> scale 1."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                            for c in cols])).alias("kv")).select("kv.*")
    q = quantiles(long, "feature", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, method=method)
    # k rows (one per feature): folded into one struct scalar, no join with the data
    d, s = _bind(df, q.select(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("q25", "q50", "q75")))).alias("m")).scalar())
    out = []
    for c in cols:
        iqr = s[c]["q75"] - s[c]["q25"]
        out.append(((F.col(c) - s[c]["q50"]) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias(c))
    return d.select(*[c for c in df.columns if c not in cols], *out)


def target_scaling(df: DataFrame, train: DataFrame, cols: list[str]) -> tuple[DataFrame, Column]:
    """Standardise targets before a fit; returns (scaled frame, stats struct) so that
    ``inverse_target_scaling`` restores predictions as x * sd + mu."""
    d, s = _bind(df, fit_standard(train, cols))
    return d.select(*[c for c in df.columns if c not in cols], "_st",
                    *[((F.col(c) - s[c]["mu"]) / s[c]["sd"]).alias(c) for c in cols]), s


def inverse_target_scaling(df: DataFrame, stats: Column, cols: list[str]) -> DataFrame:
    """E15 inverse: x * sd + mu (``df`` carries the bound stats column)."""
    return df.select(*[c for c in df.columns if c not in cols and c != "_st"],
                     *[(F.col(c) * stats[c]["sd"] + stats[c]["mu"]).alias(c) for c in cols])


__all__ = ["safe_div"]
