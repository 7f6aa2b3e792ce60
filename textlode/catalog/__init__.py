"""Every implemented operator as a query over the given tables, with its oracle."""

from importlib import import_module

MODULES = ("strings", "search", "indexes", "relations", "statistics", "sessions", "code", "records")


def load():
    from .registry import REGISTRY
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return REGISTRY
