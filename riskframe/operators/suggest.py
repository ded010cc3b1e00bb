"""Merchant dimension joins and merchant suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.dims import MERCHANT_RANGE, MERCHANTS, merchant_dim


def merchant_lookup(df: DataFrame) -> DataFrame:
    """Request x merchant dimension (amount range, opening hours, priors).
    The dimension has 10 literal rows, so it is broadcast (no shuffle of the requests)."""
    return df.join(F.broadcast(merchant_dim(df.sparkSession)), "merchant_category")


def merchant_suggestions(df: DataFrame, amount: str = "transaction_amount", k: int = 3) -> DataFrame:
    """Merchants with min <= amount <= 1.5 max ordered by |amount - mid| / max (ties in
    enum order), top k — a range join against the 10-row dimension evaluated row-locally
    with array functions (no join, no shuffle, no per-request window)."""
    a = F.col(amount)
    cands = F.array(*[F.struct(
        (F.abs(a - F.lit((lo + hi) / 2)) / F.lit(hi)).alias("fit"), F.lit(i).alias("ordinal"),
        F.lit(m).alias("merchant"), F.lit(lo).alias("lo"), F.lit(hi * 1.5).alias("hi"))
        for i, m in enumerate(MERCHANTS) for lo, hi in [MERCHANT_RANGE[m]]])
    ok = F.filter(cands, lambda c: (a >= c["lo"]) & (a <= c["hi"]))
    top = F.slice(F.sort_array(ok), 1, k)
    return df.withColumn("merchant_suggestions", F.transform(top, lambda c: c["merchant"]))
