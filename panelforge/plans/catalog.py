"""Loads every module that registers queries."""

from __future__ import annotations

from importlib import import_module

from panelforge.plans.registry import REGISTRY, Query

MODULES = ("flagship", "windows", "features", "aggregates", "drift_audit", "reports", "policies", "selection", "latent", "modelling", "storage")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"panelforge.plans.{name}")
    return REGISTRY
