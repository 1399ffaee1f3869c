"""Registered queries, grouped by pipeline."""

import importlib

from wayline import registry

MODULES = ["patterns", "bus_feed", "compare", "journeys", "detect", "scalars", "metro", "areas", "rings", "metro_journeys", "shapes"]


def _load():
    for m in MODULES:
        importlib.import_module(f"wayline.catalog.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return registry.oracles()
