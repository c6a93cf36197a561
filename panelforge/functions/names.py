"""Predicates on feature names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Name fragments and the category they stand for.
TREND = ("_slope_", "_rate_", "_diff_")
VOLATILITY = ("_std_", "_volatility_")
INTERACTION_PREFIX = "inter_"
COMPLEX_PREFIXES = ("ratio_", "diff_", "logprod_")


def has_any(name: Column, parts: tuple[str, ...]) -> Column:
    return name.rlike("|".join(parts))


def category(name: Column) -> Column:
    return (
        F.when(has_any(name, TREND), "Trend")
        .when(has_any(name, VOLATILITY), "Volatility")
        .when(name.startswith(INTERACTION_PREFIX), "Interaction")
        .otherwise("Other")
    )


def is_complex(name: Column) -> Column:
    """Change, volatility and interaction features, which the gates treat more leniently."""
    prefixed = name.startswith(INTERACTION_PREFIX)
    for p in COMPLEX_PREFIXES:
        prefixed = prefixed | name.startswith(p)
    return has_any(name, TREND + VOLATILITY) | prefixed
