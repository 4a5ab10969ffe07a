"""Queries over the fixture tables, one per operator."""

from importlib import import_module

MODULES = ["noise", "profiling", "checks", "policies", "metrics", "release"]


def load():
    """The registry with every query module imported."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.base")
