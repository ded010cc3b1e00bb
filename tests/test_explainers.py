"""Two explanations side by side (X07): ranks against plain Python, and each order sorted once per row."""

import random

from pyspark.sql import functions as F

from riskframe.operators import reports

NAMES = [f"f{i:02d}" for i in range(12)]


def _frame(spark):
    rng = random.Random(5)
    rows = [(i, *[None if rng.random() < 0.05 else float(rng.randint(-3, 3)) for _ in NAMES]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in NAMES))
    other = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 2).alias("z"))
    return rows, df.join(other, F.col("id") == F.col("k"))


def _compared(df):
    return reports.compare_explainers(df, NAMES, {n: F.col(n) * 2.0 for n in NAMES}, {n: F.abs(F.col(n)) - 1.0 for n in NAMES}, "id")


def test_ranks_and_agreement(spark):
    rows, df = _frame(spark)
    got = {(r.id, r.feature): r for r in _compared(df).collect()}
    assert len(got) == len(rows) * len(NAMES)
    for i, *values in rows:
        def ranks(f):
            order = sorted(zip(NAMES, values), key=lambda e: ((0, 0.0) if e[1] is None else (1, -abs(f(e[1]))), e[0]))
            return {n: k for k, (n, _) in enumerate(order, 1)}
        a, b = ranks(lambda v: v * 2), ranks(lambda v: abs(v) - 1)
        n = len(NAMES)
        agreement = 1 - 6 * sum((a[f] - b[f]) ** 2 for f in NAMES) / (n * (n * n - 1))
        for f in NAMES:
            r = got[i, f]
            assert (r.first_rank, r.second_rank) == (a[f], b[f])
            assert abs(r.agreement - agreement) < 1e-9


def test_orders_are_sorted_once_and_agreement_is_not_computed_per_feature(spark):
    plan = _compared(_frame(spark)[1])._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "sort" in line]
    assert len(lines) == 1 and "Join" not in lines[0]
    above = plan.split("Generate")[0]
    assert "aggregate(" not in above
