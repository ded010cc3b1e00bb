"""Scans of the given parquet tables and of user-supplied transaction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskframe.functions.dims import V_NAMES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; filters and projections applied later reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Transactions file layout: Time, V1..V28, Amount (doubles) and Class (int).
TRANSACTION_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(v, T.DoubleType()) for v in V_NAMES]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
)


def scan_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a transactions file with an explicit schema; fail fast on bad rows.

    A missing path raises (AnalysisException) as the reference does when the file
    is absent.  No schema inference pass over the data.
    """
    reader = spark.read.schema(TRANSACTION_SCHEMA)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "FAILFAST").csv(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")
