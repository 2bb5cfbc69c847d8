"""The reference operators' queries by name, with the DuckDB SQL each is held against.

Names end in the inventory's ids.  ``query`` registers a function of (spark, sf_dir) and its SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def simple(name: str, text: str, operator: Callable, sql: str | None = None) -> None:
    """operator over a view; in its SQL ``v`` is the view."""
    from loom import views

    query(name, f"WITH RECURSIVE v AS ({views.duck(text)}) {sql}" if sql else None)(lambda spark, sf_dir: operator(views.view(spark, sf_dir, text)))


for _module in ("intervals", "rewards", "text", "rl", "batch", "messages", "reports", "sources", "narration"):
    import_module(f"loom.queries.{_module}")
