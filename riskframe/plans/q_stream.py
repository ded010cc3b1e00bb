"""Catalog: A/B tests, soft vote, streaming queries (G06, G07, T04, ST01-ST09)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskframe.functions.columns import rnd
from riskframe.operators import abtest as AB
from riskframe.operators import rules as R
from riskframe.plans.catalog import query
from riskframe.plans.q_audit import _HEADER_COLS
from riskframe.session import checkpoint_dir
from riskframe.sources import metadata_views as MV
from riskframe.sources import views
from riskframe.sources.tables import table
from riskframe.operators import registry as G
from riskframe.streaming import stateful as SF
from riskframe.streaming import streams as S

_MOD = ("((('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 16))::UHUGEINT % 100 * 16 + "
        "('0x' || substr(md5(CAST(user_id AS VARCHAR)), 17, 16))::UHUGEINT % 100) % 100)")


@query("ab_assignment", f"SELECT event_id, user_id, CASE WHEN {_MOD} / 100 < 0.5 THEN 'B' ELSE 'A' END AS arm FROM events")
def ab_assignment(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    return AB.ab_assignment(ev, "user_id", True, 0.5)


@query("ab_results", f"""WITH a AS (SELECT e.event_id, CASE WHEN {_MOD} / 100 < 0.5 THEN 'B' ELSE 'A' END AS arm,
  CASE WHEN s.pred = s.y THEN 1.0 ELSE 0.0 END AS ok FROM events e JOIN scored s ON e.event_id = s.event_id),
g AS (SELECT arm, count(*) AS n, avg(ok) AS success_rate FROM a GROUP BY arm)
SELECT arm, n, round(success_rate, 9) AS success_rate,
  CASE WHEN (SELECT count(*) FROM g) = 2 AND (SELECT min(n) FROM g) >= 100
       THEN (SELECT arm FROM g ORDER BY success_rate DESC, arm DESC LIMIT 1) END AS winner FROM g""")
def ab_results(spark, sf):
    s = views.request_scores(spark, sf).select("user_id", (F.col("pred") == F.col("Class")).alias("ok"))
    a = AB.ab_assignment(s, "user_id")
    r = AB.ab_results(a, "ok", 100)
    return r.select("arm", "n", rnd("success_rate", 9).alias("success_rate"), "winner")


@query("soft_vote", "SELECT event_id, round(avg(p), 9) AS p_ensemble, count(*) AS members, "
                    "CAST(avg(p) >= 0.5 AS INTEGER) AS pred_ensemble FROM model_scores GROUP BY event_id")
def soft_vote(spark, sf):
    r = AB.soft_vote(views.model_scores(spark, sf))
    return r.select("event_id", rnd("p_ensemble", 9).alias("p_ensemble"), "members", "pred_ensemble")


_REQ = """SELECT event_id AS request_id, ts, value * power(1 + event_id % 7, 3) - 5 AS amount,
  ((event_id * 7919) % 1000) / 2000.0::DOUBLE + 0.3::DOUBLE * (CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END) AS p,
  value, event_id, user_id FROM events"""


@query("stream_metrics", f"""WITH r AS ({_REQ}),
o AS (SELECT ts, CASE WHEN amount > 0 THEN ['random_forest', 'xgboost', 'ensemble'][event_id % 3 + 1] ELSE 'unknown' END AS mapper_type,
  amount <= 0 AS is_error, CASE WHEN amount > 0 THEN value END AS latency_ms, CASE WHEN amount > 0 THEN 1 - p / 2 END AS confidence FROM r)
SELECT date_trunc('hour', ts) AS window_start, mapper_type, count(*) AS n, round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 9) AS error_rate,
  round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(confidence), 9) AS mean_confidence FROM o
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM o) - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_metrics(spark, sf):
    """ST04 in append mode: the windows that the watermark (ten minutes behind the newest event) has closed."""
    out = S.run_to_table(S.stream_metrics(S.event_stream(spark, sf)), mode="append")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "mapper_type", "n",
                      rnd("error_rate", 9).alias("error_rate"), rnd("mean_latency_ms", 6).alias("mean_latency_ms"),
                      rnd("mean_confidence", 9).alias("mean_confidence"))


@query("stream_history", f"""WITH r AS ({_REQ})
SELECT ['grocery','gas','online','restaurant','atm','department_store','pharmacy','entertainment','travel','other'][event_id % 10 + 1] AS merchant_category,
  ['normal','slightly_unusual','highly_unusual','foreign'][user_id % 4 + 1] AS location_risk,
  ['typical','slightly_higher','much_higher','suspicious'][(event_id // 10) % 4 + 1] AS spending_pattern,
  count(*) AS count, round(avg(1 - p / 2), 9) AS avg_confidence FROM r WHERE amount > 0 GROUP BY ALL""")
def stream_history(spark, sf):
    out = S.run_to_table(S.stream_history(S.event_stream(spark, sf)), mode="complete")
    return out.select("merchant_category", "location_risk", "spending_pattern", "count",
                      rnd("avg_confidence", 9).alias("avg_confidence"))


@query("stream_ab", f"SELECT event_id, user_id, CASE WHEN {_MOD} / 100 < 0.5 THEN 'B' ELSE 'A' END AS arm FROM events")
def stream_ab(spark, sf):
    return S.run_to_table(S.stream_ab(S.event_stream(spark, sf)), mode="append")


@query("stream_audit", "SELECT " + ", ".join(f'"{c}"' for c in _HEADER_COLS) + " FROM mapping_audit")
def stream_audit(spark, sf):
    """ST08: arriving operations appended to the audit tables, batch by batch; the headers that they hold."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/audit-{uuid.uuid4().hex}"
    S.run_audit(MV.operations_of(views.request_scores_of(S.event_stream(spark, sf))), root)
    return spark.read.parquet(f"{root}/audit/mapping_audit").select(*_HEADER_COLS)


@query("stream_validate", f"SELECT request_id, {R.ALL_ERRORS} AS errors, ({R.ALL_ERRORS}) IS NOT NULL AS quarantined FROM requests")
def stream_validate(spark, sf):
    """ST01: validation codes on the event stream, equal to the batch rules; accepted and quarantined requests from their own sinks."""
    accepted, quarantined = SF.to_sinks(S.stream_validate(S.event_stream(spark, sf)))
    return accepted.union(quarantined).select("request_id", "errors", "quarantined")


@query("stream_dedup", """WITH RECURSIVE e AS (SELECT user_id, ['grocery','gas','online','restaurant','atm','department_store','pharmacy','entertainment','travel','other'][event_id % 10 + 1] AS merchant_category,
  event_id, ts FROM events),
c AS (SELECT user_id, merchant_category, min(ts) AS ts FROM e GROUP BY ALL
  UNION ALL SELECT c.user_id, c.merchant_category, min(e.ts) FROM c JOIN e ON e.user_id = c.user_id AND e.merchant_category = c.merchant_category
    AND e.ts >= c.ts + INTERVAL 1 HOUR GROUP BY c.user_id, c.merchant_category, c.ts)
SELECT c.user_id, c.merchant_category, min(e.event_id) AS event_id, c.ts AS event_time FROM c JOIN e USING (user_id, merchant_category, ts) GROUP BY ALL""")
def stream_dedup(spark, sf):
    """ST03: requests of one user at one kind of merchant count once an hour."""
    r = S.request_columns(S.event_stream(spark, sf)).withColumnRenamed("request_id", "event_id")
    out = S.run_to_table(SF.stream_dedup(r, ["user_id", "merchant_category"], "event_id"))
    return out.select("user_id", "merchant_category", "event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("stream_recent_n", f"""WITH r AS ({_REQ}), o AS (SELECT *, row_number() OVER (PARTITION BY event_id % 3 ORDER BY ts DESC, event_id) AS rn FROM r WHERE amount > 0)
SELECT ['random_forest', 'xgboost', 'ensemble'][event_id % 3 + 1] AS mapper_type, count(*) AS n, round(avg(value), 6) AS mean_ms,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99 FROM o WHERE rn <= 1000 GROUP BY event_id % 3""")
def stream_recent_n(spark, sf):
    """ST07: percentiles of the latest 1000 response times of every mapper."""
    r = S.request_columns(S.event_stream(spark, sf)).where("NOT is_error")
    last = SF.recent_rows(SF.stream_recent(r, "mapper_type", "request_id", "latency_ms", 1000), "mapper_type", 1000)
    return SF.latency_summary(last, "mapper_type").select("mapper_type", "n", *[rnd(c).alias(c) for c in ("mean_ms", "p50", "p90", "p95", "p99")])


_DRIFT = ["transaction_amount", "value", "p"]
_DRIFT_SQL = f"""WITH r AS ({_REQ.replace("AS amount", "AS transaction_amount")}),
b AS (SELECT {", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in _DRIFT)} FROM r
  WHERE ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM r)),
w AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, {", ".join(f"avg({c}) AS now_{c}" for c in _DRIFT)} FROM r GROUP BY 1),
s AS (SELECT window_start, n, ({" + ".join(f"CASE WHEN std_{c} > 0 THEN least(abs(now_{c} - mean_{c}) / std_{c} / 3, 1.0) ELSE 0.0 END" for c in _DRIFT)}) / 3.0 AS score FROM w, b)
SELECT window_start, n, round(score, 6) AS drift_score, score > {G.DEFAULT_THRESHOLDS["drift"]} AS alert FROM s
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM r) - INTERVAL 10 MINUTE"""


@query("stream_drift", _DRIFT_SQL)
def stream_drift(spark, sf):
    """ST05: hourly windows against the first half of the period."""
    fields = lambda ev: ev.select("ts", (F.col("value") * F.pow(1 + F.col("event_id") % 7, 3) - 5).alias("transaction_amount"), "value",
                                  ((F.col("event_id") * 7919) % 1000 / F.lit(2000.0)
                                   + F.lit(0.3) * ((F.col("event_type") == "error") & (F.col("value") >= 100)).cast("int")).alias("p"))
    ev = table(spark, sf, "events")
    middle = ev.select(F.min("ts") + (F.max("ts") - F.min("ts")) / 2).scalar()
    base = SF.baseline_row(fields(ev).where(F.col("ts") < middle), _DRIFT)
    out = S.run_to_table(SF.stream_drift(fields(S.event_stream(spark, sf)), base, _DRIFT, G.DEFAULT_THRESHOLDS["drift"]))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", rnd("drift_score").alias("drift_score"), "alert")


@query("stream_score")
def stream_score(spark, sf):
    """ST02: the saved model's scores of arriving transactions."""
    from riskframe.functions.dims import FEATURES
    from riskframe.operators import models as ML
    from riskframe.plans.q_models import _model
    model = _model(spark, sf, "logistic_regression")
    return S.run_to_table(ML.score(model, views.txn_of(spark, sf, S.event_stream(spark, sf)).select("event_id", *FEATURES)))
