"""Shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(c: Column | str, d: int = 6) -> Column:
    """Round a double for stable cross-engine comparison of aggregates."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), d)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b; zero or null denominator -> default (ANSI-safe)."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def unpivot(df: DataFrame, cols: list[str], ids: list[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (one row per id x column), a narrow projection (no shuffle)."""
    ids = list(ids or [])
    return df.unpivot(ids, cols, name, value) if ids else \
        df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                                      for c in cols])).alias("_kv")).select(f"_kv.{name}", f"_kv.{value}")


def codes(*pairs: tuple[Column, str]) -> Column:
    """array of the codes whose condition holds, in the given order (no nulls)."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]),
                    lambda x: x.isNotNull())
