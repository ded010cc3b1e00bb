"""Stand-in views over the given test tables.

The transactions table of the surveyed application (Time, V1..V28, Amount, Class) does not
exist here; these views derive it and the other inputs from ``events`` / ``embeddings`` /
``part`` with expressions that give bit-identical doubles in Spark and DuckDB.  Every view
is a lazy DataFrame over the parquet scans, so its work grows with the tables.

``VIEW_SQL`` holds the DuckDB text of each view; ``plans.oracle`` prepends the ones an
oracle query needs as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.dims import LOCATIONS, MERCHANTS, SPENDING, V_NAMES, enum_at, sql_list
from riskframe.session import prepare
from riskframe.sources.tables import table

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since epoch of a timestamp_ntz column (time-zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), ts)


def _v_expr(i: int) -> Column:
    # V_i = embedding[i] * 10 + ((event_id * (7i + 3)) % 1000) / 1000   (i counted from 1)
    return (F.col("embedding")[i - 1].cast("double") * 10
            + (F.col("event_id") * (7 * i + 3)) % 1000 / F.lit(1000.0)).alias(f"V{i}")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, Time, V1..V28, Amount, Class.

    events joins embeddings on ``event_id % n = vec_id``; ``n`` and ``min(ts)`` are
    scalar subqueries (one-row aggregates), not cross joins.  The embeddings side is
    left to AQE: it becomes a broadcast only when its measured size is under the
    broadcast threshold, else a shuffled hash/sort-merge join on the modulus key.
    """
    t0 = table(spark, sf_dir, "events").select(F.min(epoch_micros(F.col("ts")))).scalar()
    return _txn_columns(_with_embedding(spark, sf_dir), t0)


def txn_of(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """The same columns for a stream of event rows; the table's first time and its embeddings are static.

    A stream can't hold a subquery, so the first time and the number of embeddings are
    read once, as two values.
    """
    prepare(spark)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t0 = table(spark, sf_dir, "events").agg(F.min(epoch_micros(F.col("ts")))).first()[0]
    return _txn_columns(events.withColumn("_vk", F.col("event_id") % emb.count()).join(emb, F.col("_vk") == F.col("vec_id")), F.lit(t0))


def _txn_columns(rows: DataFrame, t0: Column) -> DataFrame:
    return rows.select(
        "event_id", "ts", "user_id",
        ((epoch_micros(F.col("ts")) - t0) / F.lit(1e6)).alias("Time"),
        *[_v_expr(i) for i in range(1, 29)],
        (F.col("value") * F.pow(1 + F.col("event_id") % 7, 3)).alias("Amount"),
        _class(),
    )


def _with_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with the embedding at ``event_id % n``."""
    prepare(spark)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.select(F.count(F.lit(1))).scalar()
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value",
                                               (F.col("event_id") % n).alias("_vk"))
    return ev.join(emb, F.col("_vk") == F.col("vec_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed mapping requests derived from events (edge cases at every scale)."""
    prepare(spark)
    return table(spark, sf_dir, "events").select(*request_columns())


def request_columns() -> list[Column]:
    """The request fields of an event row, for batch and stream alike."""
    eid = F.col("event_id")
    dow = F.weekday("ts")                                   # Monday = 0
    return [
        eid.alias("request_id"), "ts", "user_id",
        (F.col("value") * F.pow(1 + eid % 7, 3) - 5).alias("transaction_amount"),
        enum_at(eid % 10, MERCHANTS).alias("merchant_category"),
        (F.hour("ts") + F.when(eid % 97 == 0, 24).otherwise(0)).cast("int").alias("hour_of_day"),
        dow.cast("int").alias("day_of_week"),
        ((dow >= 5) != (eid % 50 == 0)).alias("is_weekend"),
        enum_at(F.col("user_id") % 4, LOCATIONS).alias("location_risk"),
        enum_at(F.floor(eid / 10) % 4, SPENDING).alias("spending_pattern"),
    ]


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for regressor output: M_i = 0.9 V_i + 0.1 V_(i mod 28 + 1)."""
    t = txn(spark, sf_dir)
    return t.select("event_id", *[
        (F.lit(0.9) * F.col(f"V{i}") + F.lit(0.1) * F.col(f"V{i % 28 + 1}")).alias(f"M{i}")
        for i in range(1, 29)])


def _class() -> Column:
    return F.when((F.col("event_type") == "error") & (F.col("value") >= 100), 1).otherwise(0).cast("int").alias("Class")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, Class straight from events: no other table is needed for them."""
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", _class())


def request_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with Class, value, p and pred of the same event: one scan of events."""
    prepare(spark)
    return request_scores_of(table(spark, sf_dir, "events"))


def request_scores_of(events: DataFrame) -> DataFrame:
    """As ``request_scores``, of any events, arriving ones too: every column comes from its own row."""
    return events.select(*request_columns(), _class(), "value", "event_id") \
        .withColumn("p", _score(7919)).withColumn("pred", (F.col("p") >= 0.5).cast("int")).drop("event_id")


def _score(mult: int) -> Column:
    return ((F.col("event_id") * mult) % 1000) / F.lit(2000.0) + F.lit(0.3) * F.col("Class")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, y, p, pred — a score with ties on purpose."""
    return _classed(spark, sf_dir).select("event_id", F.col("Class").alias("y"), _score(7919).alias("p")) \
        .withColumn("pred", (F.col("p") >= 0.5).cast("int"))


MODEL_MULTIPLIERS = [("m1", 7919), ("m2", 104729), ("m3", 1299709)]


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, model, y, p, pred for three stand-in models (one scan, exploded)."""
    t = _classed(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).cast("long").alias("mult"))
                       for m, k in MODEL_MULTIPLIERS])
    x = t.select("event_id", "Class", F.explode(models).alias("m"))
    p = ((F.col("event_id") * F.col("m.mult")) % 1000) / F.lit(2000.0) + F.lit(0.3) * F.col("Class")
    return x.select("event_id", F.col("m.model").alias("model"), F.col("Class").alias("y"),
                    p.alias("p")).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def folds(spark: SparkSession, sf_dir: str, k: int = 5, seed: int = 42) -> DataFrame:
    """event_id, fold, Class: stratified k folds in md5(seed_id) order."""
    from riskframe.operators.sampling import stratified_kfold
    return stratified_kfold(_classed(spark, sf_dir), "Class",
                            "event_id", k=k, seed=seed)


# ---------------------------------------------------------------------------------------
# DuckDB text of the same views (oracle side).  Element i of a DuckDB list is 1-based.
# ---------------------------------------------------------------------------------------

def _v_sql(i: int) -> str:
    return (f"CAST(m.embedding[{i}] AS DOUBLE) * 10 + "
            f"((e.event_id * {7 * i + 3}) % 1000) / 1000.0::DOUBLE AS V{i}")


VIEW_SQL: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}

VIEW_SQL["txn"] = (
    "SELECT e.event_id, e.ts, e.user_id, "
    "(epoch_us(e.ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6::DOUBLE AS \"Time\", "
    + ", ".join(_v_sql(i) for i in range(1, 29)) + ", "
    "e.value * power(1 + e.event_id % 7, 3) AS Amount, "
    "CAST(CASE WHEN e.event_type = 'error' AND e.value >= 100 THEN 1 ELSE 0 END AS INTEGER) AS Class "
    "FROM events e JOIN embeddings m ON e.event_id % (SELECT count(*) FROM embeddings) = m.vec_id"
)
VIEW_DEPS["txn"] = []

VIEW_SQL["requests"] = (
    "SELECT event_id AS request_id, ts, user_id, "
    "value * power(1 + event_id % 7, 3) - 5 AS transaction_amount, "
    f"{sql_list(MERCHANTS)}[event_id % 10 + 1] AS merchant_category, "
    "CAST(hour(ts) + CASE WHEN event_id % 97 = 0 THEN 24 ELSE 0 END AS INTEGER) AS hour_of_day, "
    "CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, "
    "((isodow(ts) - 1 >= 5) <> (event_id % 50 = 0)) AS is_weekend, "
    f"{sql_list(LOCATIONS)}[user_id % 4 + 1] AS location_risk, "
    f"{sql_list(SPENDING)}[(event_id // 10) % 4 + 1] AS spending_pattern "
    "FROM events"
)
VIEW_DEPS["requests"] = []

VIEW_SQL["mapped"] = "SELECT event_id, " + ", ".join(
    f"0.9::DOUBLE * V{i} + 0.1::DOUBLE * V{i % 28 + 1} AS M{i}" for i in range(1, 29)) + " FROM txn"
VIEW_DEPS["mapped"] = ["txn"]

VIEW_SQL["scored"] = (
    "SELECT event_id, y, p, CAST(p >= 0.5 AS INTEGER) AS pred FROM ("
    "SELECT event_id, Class AS y, ((event_id * 7919) % 1000) / 2000.0::DOUBLE + 0.3::DOUBLE * Class AS p "
    "FROM txn)"
)
VIEW_DEPS["scored"] = ["txn"]

VIEW_SQL["model_scores"] = (
    "SELECT event_id, model, y, p, CAST(p >= 0.5 AS INTEGER) AS pred FROM ("
    "SELECT t.event_id, k.model, t.Class AS y, "
    "((t.event_id * k.mult) % 1000) / 2000.0::DOUBLE + 0.3::DOUBLE * t.Class AS p "
    "FROM txn t, (VALUES " + ", ".join(f"('{m}', {k}::BIGINT)" for m, k in MODEL_MULTIPLIERS)
    + ") k(model, mult))"
)
VIEW_DEPS["model_scores"] = ["txn"]

VIEW_SQL["folds"] = (
    "SELECT event_id, CAST((row_number() OVER (PARTITION BY Class ORDER BY md5('42_' || event_id::VARCHAR)) - 1) % 5 AS INTEGER) AS fold, Class "
    "FROM txn"
)
VIEW_DEPS["folds"] = ["txn"]

V_COLS = ", ".join(V_NAMES)


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their mapped estimate M1..M28, the original V1..V28 and a per-component
    uncertainty U_i = |M_i - V_i| / 2, all from one event row and its embedding."""
    j = _with_embedding(spark, sf_dir).select(*request_columns(), *[_v_expr(i) for i in range(1, 29)])
    m = [(F.lit(0.9) * F.col(f"V{i}") + F.lit(0.1) * F.col(f"V{i % 28 + 1}")).alias(f"M{i}") for i in range(1, 29)]
    j = j.select("*", *m)
    return j.select("*", *[(F.abs(F.col(f"M{i}") - F.col(f"V{i}")) / F.lit(2.0)).alias(f"U{i}") for i in range(1, 29)])


VIEW_SQL["mapping_rows"] = (
    "SELECT *, " + ", ".join(f"abs(M{i} - V{i}) / 2.0::DOUBLE AS U{i}" for i in range(1, 29)) + " FROM ("
    "SELECT r.*, " + ", ".join(f"t.V{i}" for i in range(1, 29)) + ", "
    + ", ".join(f"0.9::DOUBLE * t.V{i} + 0.1::DOUBLE * t.V{i % 28 + 1} AS M{i}" for i in range(1, 29))
    + " FROM requests r JOIN txn t ON r.request_id = t.event_id)"
)
VIEW_DEPS["mapping_rows"] = ["requests", "txn"]
