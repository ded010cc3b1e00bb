"""Per-row vector arithmetic over fixed-width component columns (X1..Xn), as SQL text valid
in Spark and DuckDB.  Sums are written left to right so both engines add in the same order."""

from __future__ import annotations


def comps(prefix: str, n: int = 28) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def vsum(terms: list[str]) -> str:
    return "(" + " + ".join(f"({t})" for t in terms) + ")"


def vmean(terms: list[str]) -> str:
    return f"({vsum(terms)} / {len(terms)}.0)"


def pearson(a: list[str], b: list[str], ma: str, mb: str) -> str:
    """Pearson r of two component lists given their means; NULL when a variance is 0."""
    cov = vsum([f"({x} - {ma}) * ({y} - {mb})" for x, y in zip(a, b)])
    va = vsum([f"({x} - {ma}) * ({x} - {ma})" for x in a])
    vb = vsum([f"({y} - {mb}) * ({y} - {mb})" for y in b])
    return f"(CASE WHEN {va} > 0 AND {vb} > 0 THEN {cov} / sqrt({va} * {vb}) END)"
