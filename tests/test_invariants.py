"""Invariants of operators (rows-only checks and brute-force comparisons on small data)."""

import random

from pyspark.sql import functions as F

from riskframe.operators import metrics as M
from riskframe.operators import sampling
from riskframe.functions.ranking import global_row_number, hex_bucket, md5_key
from riskframe.sources import views
from tests.conftest import SF_SMALL


def test_folds_partition_ids(spark):
    f = views.folds(spark, SF_SMALL)
    t = views.txn(spark, SF_SMALL)
    assert f.count() == t.count() == f.select("event_id").distinct().count()
    per = {(r["Class"], r["fold"]): r["n"] for r in f.groupBy("Class", "fold").agg(F.count("*").alias("n")).collect()}
    for c in (0, 1):
        sizes = [per.get((c, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_undersample_balances(spark):
    t = views.txn(spark, SF_SMALL).select("event_id", "Class")
    u = sampling.undersample(t, "Class", "event_id")
    counts = [r["n"] for r in u.groupBy("Class").agg(F.count("*").alias("n")).collect()]
    assert len(set(counts)) == 1


def test_global_row_number_is_a_permutation(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "event_id").withColumn("g", (F.col("event_id") % 3).cast("int"))
    k = md5_key(F.col("event_id"))
    r = global_row_number(df.withColumn("_k", k), [F.col("_k")], hex_bucket(F.col("_k"), 2), ["g"])
    rows = r.collect()
    for g in range(3):
        rn = sorted(x["rn"] for x in rows if x["g"] == g)
        assert rn == list(range(1, len(rn) + 1))
    # order agrees with a plain sort
    mine = [x["event_id"] for x in sorted((x for x in rows if x["g"] == 0), key=lambda x: x["rn"])]
    plain = [x["event_id"] for x in df.filter("g = 0").withColumn("_k", k).orderBy("_k").collect()]
    assert mine == plain


def _brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y != 1]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    rnd = random.Random(7)
    data = [(i, int(rnd.random() < 0.3), round(rnd.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(data, "event_id long, y int, p double")
    got = M.roc_auc(df).collect()[0]["roc_auc"]
    assert abs(got - _brute_auc([d[1] for d in data], [d[2] for d in data])) < 1e-12


def test_auc_degenerate(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.7)], "event_id long, y int, p double")
    assert M.roc_auc(df).collect()[0]["roc_auc"] == 0.5
    df2 = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5)], "event_id long, y int, p double")
    assert M.roc_auc(df2).collect()[0]["roc_auc"] == 0.5


def test_average_precision_brute_force(spark):
    rnd = random.Random(3)
    data = [(i, int(rnd.random() < 0.2), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(data, "event_id long, y int, p double")
    got = M.average_precision(df).collect()[0]["average_precision"]
    ys = [d[1] for d in data]
    ps = [d[2] for d in data]
    P = sum(ys)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y != 1)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(got - ap) < 1e-12
