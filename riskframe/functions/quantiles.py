"""Exact, distributed quantiles (linear interpolation, as pandas / DuckDB quantile_cont).

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer: fine for small groups, out of memory for a feature column of a 100 TB table.
Here a mergeable sketch first brackets every wanted rank between two values; the values
below the bracket are only counted, and just the few inside it are collapsed to
(value, count) and ranked.  Nothing but those is shuffled, however skewed or tied the
column is.  ``method='approx'`` returns the sketch's own answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most 1 / ACCURACY; brackets are four times as wide.  Groups
#: of fewer than 2 * ACCURACY values, where that is under eight ranks, are ranked as a whole.
ACCURACY = 20_000


def quantiles(long_df: DataFrame, group: str, value: str, probs: dict[str, float],
              method: str = "exact", accuracy: int = ACCURACY) -> DataFrame:
    """-> one row per group with one column per ``probs`` entry (name -> q).

    Nulls are left out; a group without values has no row.  ``group`` holds names of
    columns, so the per-group brackets are a few rows and are broadcast.
    """
    x = long_df.select(group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if method == "approx":
        return x.groupBy(group).agg(*[
            F.percentile_approx("_v", q, accuracy).alias(n) for n, q in probs.items()])
    names, margin = list(probs), 4 / accuracy
    edges = [e for n in names for e in (max(probs[n] - margin, 0.0), min(probs[n] + margin, 1.0))]
    sketch = x.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                  F.percentile_approx("_v", edges, accuracy).alias("_e"))
    bracket = sketch.select(group, "_n", F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(probs[n])).alias("q"),
                 F.when((F.col("_n") < 2 * accuracy) | F.lit(edges[2 * i] <= 0), F.col("_lo")).otherwise(F.col("_e")[2 * i]).alias("lo"),
                 F.when((F.col("_n") < 2 * accuracy) | F.lit(edges[2 * i + 1] >= 1), F.col("_hi")).otherwise(F.col("_e")[2 * i + 1]).alias("hi"))
        for i, n in enumerate(names)]).alias("_t"))
    y = x.join(F.broadcast(bracket), group)
    # One row per value inside a bracket, and one per group and bracket for all values below it.
    inside = y.select(group, "_n", "_v", F.explode("_t").alias("_t")).filter(F.col("_v") <= F.col("_t.hi")) \
        .select(group, "_n", F.col("_t.name").alias("_name"), F.col("_t.q").alias("_q"),
                F.when(F.col("_v") >= F.col("_t.lo"), F.col("_v")).alias("_v"))
    counts = inside.groupBy(group, "_n", "_name", "_q", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(group, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    pos = (F.col("_n") - 1) * F.col("_q")
    ranked = counts.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_pos", pos)
    at = lambda r: F.max(F.when((r <= F.col("_cum")) & (r > F.col("_cum") - F.col("_c")), F.col("_v")))
    two = ranked.groupBy(group, "_name").agg(at(F.floor("_pos") + 1).alias("_a"), at(F.ceil("_pos") + 1).alias("_b"),
                                             F.first("_pos").alias("_pos"))
    val = F.col("_a") + (F.col("_pos") - F.floor("_pos")) * (F.col("_b") - F.col("_a"))
    return two.groupBy(group).pivot("_name", names).agg(F.first(val))
