"""Catalogue of named queries."""

import importlib

from hotgrid.plans import registry

MODULES = ("spatial_queries", "time_queries", "panel_queries", "graph_queries", "act_queries", "io_queries")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"hotgrid.plans.{module}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
