"""Splits, samples and class-imbalance operators.

Randomness is replaced by a seeded md5 order of the row id, so every split is exact in
size, independent of partitioning, and reproducible by a SQL engine.  Global ranks use
``global_row_number`` (bucketed, parallel) instead of one-partition windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.ranking import global_row_number, hex_bucket, md5_key, numeric_bucket


def _hash_ranked(df: DataFrame, id_col: str, seed, partition_by=None, prefix_len=3) -> DataFrame:
    key = md5_key(F.col(id_col), seed)
    x = df.withColumn("_hk", key)
    return global_row_number(x, [F.col("_hk"), F.col(id_col)], hex_bucket(F.col("_hk"), prefix_len),
                             partition_by=partition_by, with_group_size="_n").drop("_hk")


def _class_key(label: str):
    return F.coalesce(F.col(label).cast("string"), F.lit("\0"))


def _cut_keys(df: DataFrame, label: str | None, id_col: str, seed, sizes, prefix_len: int):
    """Scalar map: class -> array of the last (key, id) within each of the wanted sizes.

    Only the ids and the class are ranked; the rows of ``df`` then compare their own key
    with the map (an entry per class), so the wide table is not shuffled.  ``sizes`` maps
    the class count column to the sizes, in growing order.
    """
    cls = _class_key(label) if label else F.lit("all")
    narrow = df.select(cls.alias("_cls"), F.col(id_col))
    r = _hash_ranked(narrow, id_col, seed, ["_cls"], prefix_len).withColumn("_hk", md5_key(F.col(id_col), seed))
    cuts = r.groupBy("_cls").agg(F.array(*[F.max(F.when(F.col("rn") <= n, F.struct("_hk", id_col))) for n in sizes(F.col("_n"))]).alias("cut"))
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("_cls", "cut")))).scalar()


def _within(label: str | None, id_col: str, seed, i: int):
    """The row's (key, id) is not beyond its class's i-th cut."""
    own = F.struct(md5_key(F.col(id_col), seed), F.col(id_col))
    cut = F.element_at("_cuts", _class_key(label) if label else F.lit("all"))[i]
    return F.coalesce(own <= cut, F.lit(False))


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = 0.2,
                     seed: int = 42, prefix_len: int = 3) -> DataFrame:
    """Adds ``split`` in {'train','test'}; per class the first round(test_size*n_class)
    rows in md5(seed_id) order are test — exact counts keep the class rate."""
    cuts = _cut_keys(df, label, id_col, seed, lambda n: [F.round(F.lit(test_size) * n)], prefix_len)
    return df.withColumn("_cuts", cuts) \
        .withColumn("split", F.when(_within(label, id_col, seed, 0), "test").otherwise("train")).drop("_cuts")


def three_way_split(df: DataFrame, id_col: str, test_size: float = 0.2, val_size: float = 0.1,
                    seed: int = 42, prefix_len: int = 3) -> DataFrame:
    """Test first (test_size), validation val_size/(1-test_size) of the rest, train."""
    def sizes(n):
        n_test = F.round(F.lit(test_size) * n)
        return [n_test, n_test + F.round(F.lit(val_size / (1.0 - test_size)) * (n - n_test))]
    cuts = _cut_keys(df, None, id_col, seed, sizes, prefix_len)
    split = F.when(_within(None, id_col, seed, 0), "test").when(_within(None, id_col, seed, 1), "validation").otherwise("train")
    return df.withColumn("_cuts", cuts).withColumn("split", split).drop("_cuts")


def prefix_split(df: DataFrame, order_col: str, train_frac: float = 0.8,
                 buckets: int = 4096) -> DataFrame:
    """First floor(train_frac*n) rows in ``order_col`` order are train, rest validation."""
    x = df.withColumn("_g", F.lit(0))
    r = global_row_number(x, [F.col(order_col)], numeric_bucket(x, order_col, buckets),
                          partition_by=["_g"], with_group_size="_n")
    return r.withColumn("split", F.when(F.col("rn") <= F.floor(F.lit(train_frac) * F.col("_n")),
                                        "train").otherwise("validation")).drop("rn", "_n", "_g")


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
                     prefix_len: int = 3) -> DataFrame:
    """fold = (row_number - 1) % k per class in md5(seed_id) order."""
    r = _hash_ranked(df, id_col, seed, [label], prefix_len)
    return r.withColumn("fold", ((F.col("rn") - 1) % k).cast("int")).drop("rn", "_n")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Fixed-size sample without replacement: the n smallest md5(seed_id) keys.
    Runs as TakeOrderedAndProject (per-partition top-n heaps), no full sort."""
    return df.withColumn("_hk", md5_key(F.col(id_col), seed)) \
        .orderBy("_hk", id_col).limit(n).drop("_hk")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per-class balanced weight n / (k * n_class) as a small table (label, n_class, weight).
    n and k are scalar subqueries over the per-class counts."""
    c = class_counts(df, label)
    n = c.select(F.sum("n_class")).scalar()
    k = c.select(F.count(F.lit(1))).scalar()
    return c.withColumn("weight", n.cast("double") / (k * F.col("n_class")))


def attach_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with their class weight, from a scalar map with one entry per class."""
    w = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct(_class_key(label), "weight")))).scalar()
    return df.withColumn("_w", w).withColumn(out, F.element_at("_w", _class_key(label))).drop("_w")


def pos_weight(df: DataFrame, label: str) -> DataFrame:
    """(1 - rate) / rate, and n_neg / n_pos (one aggregate row)."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("n_pos"))
    rate = F.col("n_pos") / F.col("n")
    return a.select(
        "n", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"),
        F.try_divide(F.lit(1.0) - rate, rate).alias("pos_weight_rate"),
        F.try_divide((F.col("n") - F.col("n_pos")).cast("double"), F.col("n_pos")).alias("pos_weight_ratio"))


def undersample(df: DataFrame, label: str, id_col: str, seed: int = 42, prefix_len: int = 3) -> DataFrame:
    """Every class shrunk to the minority count (first rows in md5 order)."""
    least = class_counts(df, label).select(F.min("n_class")).scalar()
    cuts = _cut_keys(df, label, id_col, seed, lambda n: [least], prefix_len)
    return df.withColumn("_cuts", cuts).filter(_within(label, id_col, seed, 0)).drop("_cuts")
