"""Compose oracle SQL: prepend the stand-in views an oracle query uses as CTEs."""

from __future__ import annotations

import re

_REGISTRY: dict[str, tuple[str, list[str]]] = {}


def register_view(name: str, sql: str, deps: list[str]) -> None:
    _REGISTRY[name] = (sql, deps)


def _load_builtin_views() -> None:
    if _REGISTRY:
        return
    from riskframe.sources import views
    for name, sql in views.VIEW_SQL.items():
        register_view(name, sql, views.VIEW_DEPS[name])
    from riskframe.sources import metadata_views
    for name, sql in metadata_views.VIEW_SQL.items():
        register_view(name, sql, metadata_views.VIEW_DEPS[name])


def _used(sql: str) -> list[str]:
    return [v for v in _REGISTRY if re.search(rf"(?<![\w.]){re.escape(v)}(?!\w)", sql)]


def with_views(sql: str) -> str:
    """Return ``sql`` with every referenced stand-in view (and its deps) as a CTE."""
    _load_builtin_views()
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        body, deps = _REGISTRY[v]
        for d in deps + _used(body):
            if d != v:
                visit(d)
        order.append(v)

    for v in _used(sql):
        visit(v)
    if not order:
        return sql
    ctes = ", ".join(f"{v} AS ({_REGISTRY[v][0]})" for v in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
