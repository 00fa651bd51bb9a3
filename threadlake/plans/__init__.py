"""Queries over the provided tables, grouped like the operator inventory."""

from importlib import import_module

_MODULES = (
    "conversations", "scalars", "predicates", "ordering", "gallery", "searching",
    "content", "changes", "ingestion", "nested", "verification", "streams", "statements",
)


def load_all() -> None:
    for name in _MODULES:
        import_module(f"threadlake.plans.{name}")
