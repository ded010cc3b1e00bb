"""Work on each row that is far larger than the row is dealt over all cores, however few partitions the table has."""

from collections import Counter

from pyspark.sql import functions as F

from riskframe.operators import models, neighbours


def test_a_one_partition_table_is_dealt_evenly(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k")).coalesce(1)
    out = neighbours.spread(df)
    parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(parts) >= 2 * cores and max(parts) <= 2 * 4000 / len(parts) + len(parts)
    assert Counter(r.k for r in out.collect()) == Counter(r.k for r in df.collect())


def test_heavy_queries_read_a_spread_table(spark, monkeypatch):
    from riskframe.plans import q_models, q_reports
    seen = []
    monkeypatch.setattr(q_models, "spread", lambda df: seen.append("models") or df)
    monkeypatch.setattr(q_reports, "spread", lambda df: seen.append("reports") or df)
    q_reports.compare_explainers(spark, "/root/testdata/sf0.001")
    assert seen == ["reports"]
    monkeypatch.setattr(q_models, "_mapper", lambda *a: None)
    monkeypatch.setattr(q_models, "_model", lambda *a: None)
    for q in (q_models.forest_uncertainty, q_models.score_requests, q_models.shapley_sampling, q_models.local_surrogate):
        try:
            q(spark, "/root/testdata/sf0.001")
        except AttributeError:                      # no model is fitted here
            pass
    assert seen.count("models") >= 2


def test_training_rows_are_dealt_evenly_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 3 * models.TRAIN_ROWS * cores, 1, 1)                     # one file's rows: one partition
    dealt = models.packed(df, df.count())
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and min(sizes) > 0.9 * max(sizes)
    assert models.packed(df, models.TRAIN_ROWS).rdd.getNumPartitions() == 1


def test_training_tasks_are_bounded_by_cores_and_rows():
    at = models.TRAIN_ROWS
    assert [models.training_tasks(n, 12) for n in (0, 1, at, at + 1, 12 * at, 500 * at)] == [1, 1, 1, 2, 12, 12]
    assert models.training_tasks(30 * models.MOST_ROWS, 12) == 30
    assert models.training_tasks(15 * at, 12, 15 * at) == 1
