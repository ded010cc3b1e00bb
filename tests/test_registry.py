"""Registry operators on small hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from riskframe.operators import audit as AU
from riskframe.operators import registry as G

PERF = "model_id string, day date, accuracy double, precision double, recall double, f1 double, auc double, drift double, error_rate double"
GOOD = (0.97, 0.95, 0.9, 0.96, 0.95, 0.01, 0.0)


def day(n):
    return dt.date(2024, 1, n)


def test_alerts_name_severity_and_actions(spark):
    perf = spark.createDataFrame([("fine", day(1), *GOOD), ("one", day(1), 0.97, 0.95, 0.9, 0.5, 0.95, 0.01, 0.0),
                                  ("two", day(1), 0.9, 0.95, 0.9, 0.96, 0.95, 0.2, 0.0), ("all", day(1), 0.1, 0.1, 0.1, 0.1, 0.1, 0.9, 0.9)], PERF)
    got = {r.model_id: (r.severity, r.actions, r.retrain) for r in G.performance_alerts(perf).collect()}
    assert got == {"one": ("medium", ["watch_trend"], False), "two": ("high", ["review_training_data", "validate_input_data"], False),
                   "all": ("critical", list(G.ACTIONS.values()), True)}


def test_status_has_every_model(spark):
    perf = spark.createDataFrame([("a", day(1), *GOOD), ("a", day(2), 0.5, *GOOD[1:])], PERF)
    versions = spark.createDataFrame([("a", "a/1", day(1), False), ("a", "a/2", day(2), True), ("b", "b/1", day(1), True)],
                                     "model_id string, version_id string, created_at date, is_active boolean")
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model_id string")
    got = {r.model_id: (r.active_version, r.accuracy, r.trend, r.health, r.production_ready) for r in G.model_status(models, versions, perf).collect()}
    assert got == {"a": ("a/2", 0.5, "stable", "unhealthy", False), "b": ("b/1", None, "insufficient", "unknown", False),
                   "c": (None, None, "insufficient", "unknown", False)}


def test_deletion_reaches_every_table(spark):
    models = spark.createDataFrame([("a",), ("b",), (None,)], "model_id string")
    history = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "model_id string, n int")
    gone = spark.createDataFrame([("a", 0), ("a", 1), (None, 2)], "model_id string, other int")
    left = G.cascade_delete(gone, "model_id", {"models": models, "history": history})
    assert {r.model_id for r in left["models"].collect()} == {"b", None}
    assert [(r.model_id, r.n) for r in left["history"].collect()] == [("b", 3)]
    assert G.cascade_delete(gone.limit(0), "model_id", {"h": history})["h"].count() == 3


def test_exports_hold_the_rows_and_empty_ones_write_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), 0.1, "x,\"y\""), (2, None, None, None)], "id int, at timestamp_ntz, v double, s string")
    for fmt in ("csv", "json"):
        path = str(tmp_path / fmt)
        assert AU.export(df, path, fmt)
        assert {tuple(r) for r in AU.exported(spark, path, fmt, df.schema).collect()} == {tuple(r) for r in df.collect()}
        assert not AU.export(df.where(F.lit(False)), str(tmp_path / f"none-{fmt}"), fmt) and not (tmp_path / f"none-{fmt}").exists()
