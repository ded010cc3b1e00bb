"""Exact global ranks without single-partition windows.

``row_number() OVER (PARTITION BY class ORDER BY key)`` puts a whole class into one task;
with a class holding most rows that is the whole table.  Here the ordering is split into
order-preserving buckets (a prefix of a hex hash, or a numeric range): rows are numbered
inside ``(group, bucket)`` windows in parallel, and a small table of per-bucket counts
(at most ``buckets x groups`` rows) supplies each bucket's starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(id_col: Column, seed: int | str = 42) -> Column:
    """Seeded pseudo-random order key, reproducible in any engine: md5('<seed>_' || id)."""
    return F.md5(F.concat(F.lit(f"{seed}_"), id_col.cast("string")))


def hex_bucket(key: Column, prefix_len: int = 3) -> Column:
    """Order-preserving bucket of a hex key: its first ``prefix_len`` characters."""
    return F.substring(key, 1, prefix_len)


def numeric_bucket(df: DataFrame, col: str, buckets: int = 4096) -> Column:
    """Order-preserving equal-width bucket of a numeric column (min/max scalar subqueries)."""
    lo = df.select(F.min(col).cast("double")).scalar()
    hi = df.select(F.max(col).cast("double")).scalar()
    width = (hi - lo) / F.lit(float(buckets))
    b = F.floor((F.col(col).cast("double") - lo) / F.when(width > 0, width).otherwise(F.lit(1.0)))
    return F.least(b, F.lit(buckets - 1))


def global_row_number(df: DataFrame, order_cols: list[Column], bucket: Column,
                      partition_by: list[str] | None = None, out: str = "rn",
                      with_group_size: str | None = None,
                      bounded_groups: bool = False) -> DataFrame:
    """Add ``out`` = 1-based row number over ``order_cols`` within ``partition_by`` groups.

    ``bucket`` must be monotone in ``order_cols`` (equal buckets for equal keys).  When
    ``bounded_groups`` the offsets table (buckets x groups rows, e.g. 4096 x 2 classes) is
    broadcast; otherwise the join is left to AQE's runtime size check.
    """
    parts = list(partition_by or [])
    b = df.withColumn("_bkt", bucket)
    local = b.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy(*parts, "_bkt").orderBy(*order_cols)))
    counts = b.groupBy(*parts, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*parts).orderBy("_bkt")
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    if with_group_size:
        offsets = offsets.withColumn(with_group_size, F.sum("_cnt").over(Window.partitionBy(*parts)))
    offsets = offsets.drop("_cnt")
    if bounded_groups:
        offsets = F.broadcast(offsets)
    res = local.join(offsets, parts + ["_bkt"])
    return res.withColumn(out, (F.col("_off") + F.col("_lrn")).cast("long")).drop("_bkt", "_lrn", "_off")


def global_cumsum(df: DataFrame, order_col: str, bucket: Column, values: list[str],
                  partition_by: list[str] | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``values`` in ``order_col`` order within groups, computed
    per order-preserving bucket in parallel plus a small per-bucket offsets table."""
    parts = list(partition_by or [])
    b = df.withColumn("_bkt", bucket)
    w_local = Window.partitionBy(*parts, "_bkt").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(v).over(w_local).alias(f"_l_{v}") for v in values])
    tots = b.groupBy(*parts, "_bkt").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w = Window.partitionBy(*parts).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = tots.select(*parts, "_bkt", *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}")
                                         for v in values])
    res = local.join(offs, parts + ["_bkt"])
    return res.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{prefix}{v}") for v in values])


def depth_bucket(df: DataFrame, col: str, out: str = "_depth", buckets: int = 256) -> DataFrame:
    """Add an order-preserving bucket of ``col`` with bounds from the data: approximate
    quantiles, so that massed values spread over many buckets.  Equal values share one.

    The bucket is the number of bounds below the value: every 16th bound is compared first, then
    the 15 behind the last of these that is below.
    """
    bounds = df.select(F.percentile_approx(F.col(col).cast("double"), [i / buckets for i in range(1, buckets)], 10_000).alias("every")) \
        .select(F.struct("every", F.filter("every", lambda b, i: (i + 1) % 16 == 0).alias("some"))).scalar()
    below = lambda a: F.size(F.filter(a, lambda b: b < F.col(col)))
    coarse = df.withColumn("_bounds", bounds).withColumn("_coarse", 16 * below(F.col("_bounds")["some"]))
    fine = below(F.slice(F.col("_bounds")["every"], F.col("_coarse") + 1, 15))
    return coarse.withColumn(out, F.coalesce(F.col("_coarse") + fine, F.lit(0))).drop("_bounds", "_coarse")


def unit_bucket(col: str, buckets: int = 4096) -> Column:
    """Order-preserving bucket for scores in [0, 1] (values outside are clipped)."""
    return F.least(F.greatest(F.floor(F.col(col) * buckets), F.lit(0)), F.lit(buckets)).cast("int")
