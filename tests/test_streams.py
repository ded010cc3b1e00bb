"""Streams over a table that is a folder of part files, and late rows."""

from pyspark.sql import functions as F

from riskframe.streaming import streams
from tests.conftest import SF_SMALL


def test_folder_table_is_read_whole(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = streams.run_to_table(streams.stream_ab(streams.event_stream(spark, str(tmp_path), 10)))
    assert out.count() == ev.count()


def test_correlations_are_pairwise(spark):
    from riskframe.operators.profile import correlation_matrix
    df = spark.createDataFrame([(float(i), float(i * i % 7), None if i % 2 else 1.0) for i in range(40)], "a double, b double, c double")
    got = {(r.f_i, r.f_j): r["corr"] for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    want = df.select(F.corr("a", "b")).first()[0]
    assert abs(got["a", "b"] - want) < 1e-12 and got["a", "a"] == 1.0 and len(got) == 9


def test_quantiles_on_tied_and_skewed_values(spark):
    import numpy as np
    from riskframe.functions.quantiles import quantiles
    values = [0.0] * 600 + [1e9] + [float(i) ** 3 for i in range(300)]
    df = spark.createDataFrame([("x", v) for v in values] + [("x", None), ("one", 5.0)], "g string, v double")
    got = {r.g: r for r in quantiles(df, "g", "v", {"a": 0.25, "b": 0.7, "c": 0.999, "d": 1.0, "e": 0.0}).collect()}
    large = quantiles(spark.range(3000).selectExpr("'x' AS g", "pow(id % 1000, 3) AS v"), "g", "v", {"a": 0.25, "b": 0.777}, accuracy=100).first()
    whole = [float(i % 1000) ** 3 for i in range(3000)]
    assert [round(large[n], 3) for n in ("a", "b")] == [round(float(np.quantile(whole, q)), 3) for q in (0.25, 0.777)]
    for n, q in {"a": 0.25, "b": 0.7, "c": 0.999, "d": 1.0, "e": 0.0}.items():
        assert abs(got["x"][n] - np.quantile(values, q)) <= 1e-9 * max(1, abs(np.quantile(values, q)))
        assert got["one"][n] == 5.0
