"""A/B assignment and results (G06, G07), soft voting of member scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def md5_mod_100(key: Column) -> Column:
    """int(md5(key), 16) % 100 exactly: the 128-bit value split into two 64-bit halves,
    x mod 100 = (hi mod 100 * 16 + lo mod 100) mod 100 because 2^64 mod 100 = 16."""
    h = F.md5(key)
    hi = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    return ((hi % 100) * 16 + (lo % 100)) % 100


def ab_assignment(df: DataFrame, user: str, test_active: Column | bool = True, split: float = 0.5) -> DataFrame:
    """md5(user) mod 100 / 100 < split -> 'B' else 'A'; inactive test -> no arm."""
    active = test_active if isinstance(test_active, Column) else F.lit(test_active)
    arm = F.when(active, F.when(md5_mod_100(F.col(user).cast("string")) / 100 < split, "B").otherwise("A"))
    return df.withColumn("arm", arm)


def ab_results(assigned: DataFrame, success: str, min_sample_size: int = 100) -> DataFrame:
    """Per arm n and mean success; a winner only when both arms reach the minimum size."""
    g = assigned.filter(F.col("arm").isNotNull()).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(success).cast("double")).alias("success_rate"))
    both = g.select(F.struct(F.min("n").alias("min_n"), F.count(F.lit(1)).alias("arms"),
                             F.max_by("arm", F.struct("success_rate", "arm")).alias("best"))).scalar()
    return g.withColumn("winner", F.when((both["arms"] == 2) & (both["min_n"] >= min_sample_size), both["best"]))


def soft_vote(member_scores: DataFrame, id_col: str = "event_id", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Ensemble probability = mean of the members' probabilities per row."""
    return member_scores.groupBy(id_col).agg(F.avg(p).alias("p_ensemble"), F.count(F.lit(1)).alias("members")) \
        .withColumn("pred_ensemble", (F.col("p_ensemble") >= threshold).cast("int"))
