"""Fixed values that results must agree on, and the small dimension tables built from them.

Dimension tables here are built from literals, so their size is bounded by this file
(at most a few dozen rows); they are the only frames the library broadcasts by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

V_NAMES = [f"V{i}" for i in range(1, 29)]
FEATURES = ["Time"] + V_NAMES + ["Amount"]          # model input order, by name

# --- fixed values: enum members in declaration order (ordinal = position) -------------
MERCHANTS = ["grocery", "gas", "online", "restaurant", "atm", "department_store",
             "pharmacy", "entertainment", "travel", "other"]
LOCATIONS = ["normal", "slightly_unusual", "highly_unusual", "foreign"]
SPENDING = ["typical", "slightly_higher", "much_higher", "suspicious"]

# --- fixed values: validator amount range (min, max) and opening hours per merchant -----
MERCHANT_RANGE = {
    "grocery": (5.0, 300.0), "gas": (10.0, 150.0), "online": (15.0, 1000.0),
    "restaurant": (8.0, 200.0), "atm": (20.0, 800.0), "department_store": (20.0, 500.0),
    "pharmacy": (5.0, 100.0), "entertainment": (10.0, 300.0), "travel": (50.0, 5000.0),
    "other": (1.0, 10000.0),
}
MERCHANT_HOURS = {
    "grocery": (6, 23), "gas": (0, 23), "online": (0, 23), "restaurant": (6, 23),
    "atm": (0, 23), "department_store": (8, 22), "pharmacy": (7, 22),
    "entertainment": (10, 23), "travel": (5, 23), "other": (0, 23),
}
ALWAYS_OPEN = ["gas", "atm", "online"]
PEAK_HOURS = {"restaurant": [12, 13, 18, 19, 20], "grocery": [10, 11, 17, 18, 19]}

# --- fixed values: confidence scorer's own typical ranges and per-merchant history prior --
SCORER_RANGE = {
    "grocery": (10.0, 200.0), "gas": (20.0, 100.0), "online": (15.0, 500.0),
    "restaurant": (10.0, 150.0), "atm": (20.0, 500.0), "department_store": (25.0, 300.0),
    "pharmacy": (5.0, 100.0), "entertainment": (15.0, 200.0), "travel": (100.0, 2000.0),
    "other": (5.0, 1000.0),
}
MERCHANT_PRIOR = {
    "grocery": 0.85, "gas": 0.80, "restaurant": 0.82, "atm": 0.75, "online": 0.70,
    "department_store": 0.78, "pharmacy": 0.83, "entertainment": 0.72, "travel": 0.65,
    "other": 0.60,
}
# confidence weights: completeness, consistency, uncertainty, bounds, agreement, history
CONFIDENCE_WEIGHTS = (0.20, 0.25, 0.20, 0.15, 0.10, 0.10)

# --- fixed values: risk factors of the conservative fallback ----------------------------
LOCATION_RISK_FACTOR = {"normal": 0.0, "slightly_unusual": 0.3, "highly_unusual": 0.6,
                        "foreign": 0.8}
SPENDING_RISK_FACTOR = {"typical": 0.0, "slightly_higher": 0.2, "much_higher": 0.5,
                        "suspicious": 0.9}


def enum_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ordinal(col: Column, values: list[str]) -> Column:
    """enum -> declaration index (0-based); unknown -> null."""
    pos = F.array_position(enum_array(values), col)
    return F.when(pos > 0, (pos - 1).cast("int"))


def enum_at(idx: Column, values: list[str]) -> Column:
    """index (0-based) -> enum value."""
    return F.element_at(enum_array(values), (idx + 1).cast("int"))


def lookup(col: Column, mapping: dict, default=None) -> Column:
    """Inline map lookup (stays inside whole-stage codegen, no join)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = m[col]
    return out if default is None else F.coalesce(out, F.lit(default))


def merchant_dim(spark: SparkSession) -> DataFrame:
    """10-row merchant dimension: ordinal, validator range, hours, scorer range, prior."""
    rows = []
    for i, m in enumerate(MERCHANTS):
        lo, hi = MERCHANT_RANGE[m]
        op, cl = MERCHANT_HOURS[m]
        slo, shi = SCORER_RANGE[m]
        rows.append((m, i, lo, hi, op, cl, slo, shi, MERCHANT_PRIOR[m]))
    schema = T.StructType([
        T.StructField("merchant_category", T.StringType()),
        T.StructField("merchant_ordinal", T.IntegerType()),
        T.StructField("min_amount", T.DoubleType()),
        T.StructField("max_amount", T.DoubleType()),
        T.StructField("open_hour", T.IntegerType()),
        T.StructField("close_hour", T.IntegerType()),
        T.StructField("scorer_min", T.DoubleType()),
        T.StructField("scorer_max", T.DoubleType()),
        T.StructField("merchant_prior", T.DoubleType()),
    ])
    return spark.createDataFrame(rows, schema)


def merchant_dim_sql() -> str:
    """The same dimension as a DuckDB VALUES list (oracle side)."""
    rows = []
    for i, m in enumerate(MERCHANTS):
        lo, hi = MERCHANT_RANGE[m]
        op, cl = MERCHANT_HOURS[m]
        slo, shi = SCORER_RANGE[m]
        rows.append(f"('{m}', {i}, {lo}::DOUBLE, {hi}::DOUBLE, {op}, {cl}, {slo}::DOUBLE, "
                    f"{shi}::DOUBLE, {MERCHANT_PRIOR[m]}::DOUBLE)")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(merchant_category, "
            "merchant_ordinal, min_amount, max_amount, open_hour, close_hour, scorer_min, "
            "scorer_max, merchant_prior)")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_case(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else
                     f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"

# --- fixed values: linear fallback weights for V1..V3 over the normalised indicator vector
# [amount, merchant, location, spending, hour_sin, hour_cos, day, weekend]
LINEAR_WEIGHTS_FIXED = [
    [0.3, 0.2, 0.1, 0.3, 0.05, 0.05, 0.0, 0.0],
    [0.2, 0.3, 0.2, 0.2, 0.05, 0.05, 0.0, 0.0],
    [0.1, 0.1, 0.4, 0.3, 0.05, 0.05, 0.0, 0.0],
]


def linear_weights() -> list[list[float]]:
    """28 x 8 weights: the three fixed rows, then a deterministic rule for V4..V28 (the
    reference draws those rows from an unseeded generator, so no value can be matched)."""
    rows = [list(r) for r in LINEAR_WEIGHTS_FIXED]
    for i in range(4, 29):
        rows.append([(((7 * i + 3 * j) % 11) - 5) / 50.0 for j in range(8)])
    return rows
