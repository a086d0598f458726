"""All registered queries, one per operator."""

from __future__ import annotations

import importlib

from dwellspark.plans.registry import ORACLES, QUERIES

_MODULES = ["scalars", "aggregates", "searches", "joinshapes", "repairs", "resolution", "valuations", "incrementals"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"dwellspark.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
