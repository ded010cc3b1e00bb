"""Projections, schema alignment and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.dims import FEATURES, LOCATIONS, MERCHANTS, SPENDING, ordinal

REQUIRED_FIELDS = ["transaction_amount", "merchant_category", "hour_of_day", "day_of_week",
                   "location_risk", "spending_pattern"]

REQUEST_SCHEMA = T.StructType([
    T.StructField("transaction_amount", T.DoubleType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("hour_of_day", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("is_holiday", T.BooleanType()),
    T.StructField("location_risk", T.StringType()),
    T.StructField("spending_pattern", T.StringType()),
])

# fixed value: the reference reseeds its generator on every call, so its "random minutes
# within the hour" is always the same draw (randint(0, 3600) after seed 42).
CONTEXT_TIME_JITTER = 2619


def align_features(df: DataFrame, features: list[str] = FEATURES, keep: list[str] | None = None) -> DataFrame:
    """Expected features in fixed order; absent -> 0.0, null -> 0.0, extras dropped."""
    present = set(df.columns)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in present
            else F.lit(0.0).alias(c) for c in features]
    return df.select(*(keep or []), *cols)


def missing_features(df: DataFrame, features: list[str] = FEATURES) -> list[str]:
    """U05 (schema level): expected features not present in a frame."""
    return [c for c in features if c not in set(df.columns)]


def feature_label_split(df: DataFrame, label: str = "Class") -> tuple[DataFrame, DataFrame]:
    """(features frame, label frame) — projections of the same scan."""
    return df.drop(label), df.select(label)


def parse_requests(raw: DataFrame, json_col: str = "body", keep: list[str] | None = None) -> DataFrame:
    """JSON request text -> typed columns + the list of missing required fields.
    Weekend derived as day_of_week >= 5 when absent; holiday defaults to false."""
    p = raw.select(*(keep or []), F.from_json(F.col(json_col), REQUEST_SCHEMA).alias("r")).select(*(keep or []), "r.*")
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_FIELDS]),
                       lambda x: x.isNotNull())
    return p.withColumn("is_weekend", F.coalesce(F.col("is_weekend"), F.col("day_of_week") >= 5)) \
        .withColumn("is_holiday", F.coalesce(F.col("is_holiday"), F.lit(False))) \
        .withColumn("missing_fields", missing)


def reject_invalid(df: DataFrame) -> DataFrame:
    """Hard domain checks -> ``reject_reason`` (null when accepted).  Callers split
    with two filters (accepted / rejected) over the same projection."""
    h, d, a = F.col("hour_of_day"), F.col("day_of_week"), F.col("transaction_amount")
    reason = (F.when(~h.between(0, 23), "hour_out_of_range")
              .when(~d.between(0, 6), "day_out_of_range")
              .when(a < 0, "negative_amount")
              .when(ordinal(F.col("merchant_category"), MERCHANTS).isNull(), "unknown_merchant")
              .when(ordinal(F.col("location_risk"), LOCATIONS).isNull(), "unknown_location")
              .when(ordinal(F.col("spending_pattern"), SPENDING).isNull(), "unknown_spending"))
    return df.withColumn("reject_reason", reason)


def encode_ordinals(df: DataFrame) -> DataFrame:
    """Enum -> declaration index."""
    return df.withColumn("merchant_ordinal", ordinal(F.col("merchant_category"), MERCHANTS)) \
        .withColumn("location_ordinal", ordinal(F.col("location_risk"), LOCATIONS)) \
        .withColumn("spending_ordinal", ordinal(F.col("spending_pattern"), SPENDING))


def hour_sin(h: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * h / 24)


def hour_cos(h: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * h / 24)


INTERPRETABLE = ["amount", "merchant", "location", "spending", "hour_sin", "hour_cos", "day", "weekend"]


def interpretable_vector(df: DataFrame, out: str = "x") -> DataFrame:
    """The 8-element vector [amount, merchant, location, spending, sin h, cos h, dow, weekend]."""
    h = F.col("hour_of_day")
    return df.withColumn(out, F.array(
        F.col("transaction_amount").cast("double"),
        ordinal(F.col("merchant_category"), MERCHANTS).cast("double"),
        ordinal(F.col("location_risk"), LOCATIONS).cast("double"),
        ordinal(F.col("spending_pattern"), SPENDING).cast("double"),
        hour_sin(h), hour_cos(h), F.col("day_of_week").cast("double"),
        F.col("is_weekend").cast("int").cast("double")))


def context_time(df: DataFrame, out: str = "Time") -> DataFrame:
    """dow*86400 + hour*3600 + the reference's constant jitter."""
    return df.withColumn(out, (F.col("day_of_week") * 86400 + F.col("hour_of_day") * 3600
                               + CONTEXT_TIME_JITTER).cast("double"))


def assemble_vector(df: DataFrame, v: str = "v", time: str = "Time", amount: str = "transaction_amount",
                    out: str = "features") -> DataFrame:
    """Time + V1..V28 + Amount as one 30-element array; only rows whose V has exactly
    28 entries are assembled (others get a null vector and ``vector_error``)."""
    ok = F.size(F.col(v)) == 28
    return df.withColumn(out, F.when(ok, F.concat(F.array(F.col(time).cast("double")), F.col(v),
                                                  F.array(F.col(amount).cast("double"))))) \
        .withColumn("vector_error", F.when(~ok, F.lit("expected_28_components")))


def vector_to_map(df: DataFrame, vec: str, names: list[str], out: str = "named") -> DataFrame:
    """Name -> value map."""
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col(vec)))


def input_enrichment(df: DataFrame, out: str = "xn") -> DataFrame:
    """Normalised fraud indicators: [min(amount/1000, 5), merchant/10, location/4,
    spending/4, sin h, cos h, dow/7, weekend]; unknown merchant -> 9, others -> 0."""
    h = F.col("hour_of_day")
    m = F.coalesce(ordinal(F.col("merchant_category"), MERCHANTS), F.lit(9))
    lo = F.coalesce(ordinal(F.col("location_risk"), LOCATIONS), F.lit(0))
    s = F.coalesce(ordinal(F.col("spending_pattern"), SPENDING), F.lit(0))
    return df.withColumn(out, F.array(
        F.least(F.col("transaction_amount") / 1000, F.lit(5.0)),
        m / F.lit(10.0), lo / F.lit(4.0), s / F.lit(4.0), hour_sin(h), hour_cos(h),
        F.col("day_of_week") / F.lit(7.0), F.col("is_weekend").cast("int").cast("double")))
