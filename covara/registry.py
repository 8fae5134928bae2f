"""Named queries over the tables of a scale-factor folder, and SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from covara.plans.registered import QUERIES, SQL, Query

for _name in ("course", "cases", "maintenance", "retrieval", "texts", "chunks", "objectives", "figures", "audits", "items", "screens", "coverage", "scalars", "streams", "sources", "payloads"):
    import_module(f"covara.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
