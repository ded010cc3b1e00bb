"""The whole path of a request, and the audit stream's replay."""

import pytest
from pyspark.sql import functions as F

from riskframe.functions.dims import FEATURES, V_NAMES
from riskframe.operators import bounds, mapper, models, serving
from riskframe.operators import confidence as C
from riskframe.operators import rules as R
from riskframe.plans import q_confidence
from riskframe.sources import metadata_views as MV
from riskframe.sources import views
from riskframe.streaming import streams as S
from tests.conftest import SF_SMALL


def test_requests_end_to_end(spark):
    rows = mapper.request_features(views.mapping_rows(spark, SF_SMALL)).select("request_id", "features", *V_NAMES)
    mapping = mapper.MultiOutputRegressor("forest", V_NAMES, trees=2, depth=3).fit(rows)
    txn = views.txn(spark, SF_SMALL).select("event_id", *FEATURES, "Class")
    model = models.train(txn, FEATURES, "logistic_regression", max_iter=20)
    history = C.historical_confidence(q_confidence.history(spark, SF_SMALL))
    requests = views.requests(spark, SF_SMALL)
    limits = {r.feature: (r["min"], r["max"]) for r in bounds.feature_bounds(txn).collect()}
    results, errors = serving.score_requests(requests, {"forest": mapping}, bounds.feature_bounds(txn), {"lr": model}, history, mapper="absent", classifier="absent")
    got, bad = results.collect(), {r.request_id: r.errors for r in errors.collect()}
    want_bad = {r.request_id for r in requests.where(F.expr(R.ALL_ERRORS).isNotNull()).collect()}
    assert set(bad) == want_bad and want_bad and all(bad.values())
    assert sorted([r.request_id for r in got] + list(bad)) == sorted(r.request_id for r in requests.select("request_id").collect())
    for r in got:
        assert abs(r.fraud_probability + r.normal_probability - 1) < 1e-9 and abs(r.risk_score - 100 * r.fraud_probability) < 1e-9
        assert r.prediction == int(r.fraud_probability > 0.5) and 0 <= r.mapping_confidence <= 1 and r.narrative
        assert r.use_fallback == (r.mapping_confidence < 0.7) and (r.mapper_used, r.model_used) == ("forest", "lr")
        assert r.n_changed == 0 or r.n_violations > 0
    # a request's amount beyond the transactions' is the one violation of Amount
    beyond = {r.request_id for r in requests.where(F.col("transaction_amount") > limits["Amount"][1]).collect()} - want_bad
    assert all(r.n_violations > 0 for r in got if r.request_id in beyond)
    with pytest.raises(ValueError):
        serving.score_requests(requests, {}, bounds.feature_bounds(txn), {"lr": model}, history)


def test_choose():
    assert serving.choose("b", {"a": 1, "b": 2}) == ("b", 2)
    assert serving.choose("c", {"a": 1, "b": 2}) == ("a", 1) and serving.choose(None, {"a": 1}) == ("a", 1)


def test_replayed_audit_batch_counts_once(spark, tmp_path):
    ops = MV.operations(spark, SF_SMALL)
    first, second = ops.where("request_id % 2 = 0"), ops.where("request_id % 2 = 1")
    for batch, n in ((first, 0), (second, 1), (second, 1)):
        S.audit_sink(batch, n, str(tmp_path))
    out = spark.read.parquet(f"{tmp_path}/mapping_audit")
    assert out.count() == out.select("id").distinct().count() == ops.count()
