"""SQL expression text valid in both Spark SQL and DuckDB.

Row-level rules are written once as SQL expressions: Spark compiles them through
``F.expr`` (Catalyst, whole-stage codegen), and the same text is the DuckDB oracle.
Numeric results are cast to DOUBLE so decimal literals never leak into outputs.
"""

from __future__ import annotations


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"CAST({float(v)!r} AS DOUBLE)")
        for k, v in mapping.items())
    return f"(CASE {col} {whens} ELSE {default} END)"


def codes(*pairs: tuple[str, str]) -> str:
    """Comma-joined codes whose condition holds, NULL when none (order kept)."""
    parts = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in pairs)
    return f"NULLIF(concat_ws(',', {parts}), '')"


def first_code(*pairs: tuple[str, str]) -> str:
    """The first matching code only (if/elif chain), NULL when none."""
    whens = " ".join(f"WHEN {cond} THEN '{code}'" for cond, code in pairs)
    return f"(CASE {whens} END)"


def join_codes(*exprs: str) -> str:
    return f"NULLIF(concat_ws(',', {', '.join(exprs)}), '')"


def in_list(col: str, values: list[str]) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"
