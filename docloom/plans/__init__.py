"""Query catalogue."""

from importlib import import_module
from types import ModuleType

#: Modules whose import registers queries.
MODULES: tuple[str, ...] = ("retrieval", "filters", "lane_queries", "documents", "evaluation", "operations", "facts", "wording")


def load_catalogue() -> ModuleType:
    for name in MODULES:
        import_module(f"docloom.plans.{name}")
    return import_module("docloom.plans.catalogue")
