"""Mapping quality between original and mapped component tables (Q01-Q08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import clamp, safe_div
from riskframe.operators.profile import pairwise_correlations


def correlation_preservation(orig: DataFrame, mapped: DataFrame, ocols: list[str], mcols: list[str]) -> DataFrame:
    """Q01: Pearson r between the upper triangles of the two k x k correlation matrices
    (undefined entries -> 0), as (r + 1) / 2 clamped.  Each matrix is one lazy aggregate
    over the pairs of columns; two tables of k * k rows meet."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    a = pairwise_correlations(orig, ocols).where("i < j").select("i", "j", zero("r").alias("a"))
    b = pairwise_correlations(mapped, mcols).where("i < j").select("i", "j", zero("r").alias("b"))
    return a.join(b, ["i", "j"]).agg(F.corr("a", "b").alias("r")).select(
        clamp((F.coalesce(F.col("r"), F.lit(0.0)) + 1) / 2).alias("correlation_preservation"))


def distribution_similarity(long: DataFrame, bins: int = 49) -> DataFrame:
    """Q02: per component, histograms of original and mapped values over their combined
    range (equal bins, last one right-closed), normalised, +1e-10, renormalised; score =
    1 - Jensen-Shannon distance (natural log).  ``long`` = (component, source in {o, m},
    value).  Counts are one groupBy; the dense bin grid is component x bins rows."""
    rng = long.groupBy("component").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = long.join(F.broadcast(rng), "component").withColumn(
        "bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.when(w > 0, w).otherwise(F.lit(1.0))),
                       F.lit(bins - 1)).cast("int"))
    cnt = b.groupBy("component", "bin").agg(F.sum((F.col("source") == "o").cast("double")).alias("co"),
                                            F.sum((F.col("source") == "m").cast("double")).alias("cm"))
    grid = rng.select("component", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = grid.join(cnt, ["component", "bin"], "left").na.fill(0.0, ["co", "cm"])
    tot = g.groupBy("component").agg(F.sum("co").alias("to"), F.sum("cm").alias("tm"))
    g = g.join(tot, "component").withColumn("p0", F.col("co") / F.col("to") + 1e-10) \
        .withColumn("q0", F.col("cm") / F.col("tm") + 1e-10)
    t2 = g.groupBy("component").agg(F.sum("p0").alias("sp"), F.sum("q0").alias("sq"))
    g = g.join(t2, "component").withColumn("p", F.col("p0") / F.col("sp")).withColumn("q", F.col("q0") / F.col("sq")) \
        .withColumn("m", (F.col("p") + F.col("q")) / 2)
    js = g.groupBy("component").agg(
        ((F.sum(F.col("p") * F.log(F.col("p") / F.col("m"))) + F.sum(F.col("q") * F.log(F.col("q") / F.col("m")))) / 2)
        .alias("jsd"))
    return js.select("component", (1 - F.sqrt(F.greatest(F.col("jsd"), F.lit(0.0)))).alias("similarity"))


def prediction_consistency(pairs: DataFrame, p1: str = "p1", p2: str = "p2") -> DataFrame:
    """Q03: (share of |p1 - p2| <= .1 + max(0, corr)) / 2, clamped."""
    a = pairs.agg(F.avg((F.abs(F.col(p1) - F.col(p2)) <= 0.1).cast("double")).alias("agree"),
                  F.corr(p1, p2).alias("r"))
    return a.select("agree", "r", clamp((F.col("agree") + F.greatest(F.lit(0.0), F.coalesce(F.col("r"), F.lit(0.0)))) / 2)
                    .alias("prediction_consistency"))


def mapping_uncertainty(mapped: DataFrame, mcols: list[str], ucols: list[str] | None) -> DataFrame:
    """Q04: with estimates min(1, mean/2); without, min(1, mean population variance / 5)."""
    var = sum((F.var_pop(c) for c in mcols), F.lit(0.0)) / len(mcols)
    aggs = [F.least(F.lit(1.0), var / 5).alias("uncertainty_from_variance")]
    if ucols:
        aggs.append(F.least(F.lit(1.0), (sum((F.avg(c) for c in ucols), F.lit(0.0)) / len(ucols)) / 2)
                    .alias("uncertainty_from_estimates"))
    return mapped.agg(*aggs)


def reference_validation(stats: DataFrame) -> DataFrame:
    """Q06: per component relative errors of mean and population std, score max(0, 1 -
    (a + b)/2), the within-range share; ``stats`` has mean_o, std_o, mean_m, std_m, inrange."""
    a = safe_div(F.abs(F.col("mean_m") - F.col("mean_o")), F.abs(F.col("mean_o")))
    b = safe_div(F.abs(F.col("std_m") - F.col("std_o")), F.col("std_o"))
    return stats.withColumn("mean_rel_error", a).withColumn("std_rel_error", b) \
        .withColumn("score", F.greatest(F.lit(0.0), 1 - (a + b) / 2))


QUALITY_LEVEL = ("(CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.8 THEN 'good' WHEN s >= 0.7 THEN 'acceptable' "
                 "WHEN s >= 0.6 THEN 'poor' ELSE 'unacceptable' END)")
