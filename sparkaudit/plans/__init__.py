"""Registered queries. Importing a module of this package registers its queries."""

from importlib import import_module

MODULES = ("text_queries", "relational_queries", "stat_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"sparkaudit.plans.{name}")
