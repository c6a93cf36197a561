"""Row-wise derived features and the fitted state some of them need."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions import exprs as X
from panelforge.operators.quantiles import fit_quantiles

QUINTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def fit_bin_edges(train: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUINTILES) -> dict[str, list[float]]:
    """Quantile edges of the training rows; kept as state so other rows are binned by the same edges."""
    return fit_quantiles(train, {c: (F.col(c), list(probs)) for c in cols})


def physical_ratios(role: Mapping[str, str], inflow_step: str, congestion_step: str) -> dict[str, Column]:
    """Load, charging and density ratios; ``role`` names the column that plays each part."""
    c = {k: F.col(v) for k, v in role.items()}
    # Output names and the offsets of denominators.
    return {
        "surge_velocity": F.col(inflow_step) / (c["active"] + 1.0),
        "load_utilization_ratio": c["inflow"] / (c["utilization"] + 1e-6),
        "charging_stress": c["charge_wait"] * c["low_battery"],
        "robot_density": c["active"] / (c["inflow"] + 1.0),
        "sku_density": c["skus"] / (c["inflow"] + 1.0),
        "congestion_surge": F.col(congestion_step) * c["inflow"],
        "battery_starvation": c["low_battery"] * c["active"],
    }


def capacity_ratios(role: Mapping[str, str]) -> dict[str, Column]:
    """Work per active unit and pressure per idle unit."""
    # Output names.
    pairs = {
        "inflow_per_active": ("inflow", "active"),
        "congestion_per_active": ("congestion", "active"),
        "density_per_idle": ("density", "idle"),
        "battery_stress_idle": ("battery", "idle"),
        "congestion_per_idle": ("congestion", "idle"),
        "inflow_per_idle": ("inflow", "idle"),
    }
    return {n: F.col(role[a]) / (F.col(role[b]) + 1e-6) for n, (a, b) in pairs.items()}


def extreme_flags(limits: Mapping[str, float], lead: str) -> dict[str, Column]:
    """``is_extreme`` (the lead column at or above its limit) and ``is_extreme_multi`` (any column is)."""
    over = {c: F.coalesce(F.col(c) >= F.lit(q), F.lit(False)) for c, q in limits.items()}
    hit = F.lit(False)
    for o in over.values():
        hit = hit | o
    return {"is_extreme": over[lead].cast("int"), "is_extreme_multi": hit.cast("int")}


def early_warning(inflow_step: Column, inflow_rel: Column, util_rel: Column, util_p90: float) -> dict[str, Column]:
    flag = (inflow_step > 0) & (util_rel > F.lit(util_p90))
    return {
        "early_warning_flag": F.coalesce(flag.cast("int"), F.lit(0)),
        "early_warning_score": inflow_rel + util_rel,
    }


# --- fit / apply pairs ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnState:
    low: float
    high: float
    mean: float
    std: float
    clipped_std: float


SENSITIVE = ("_rate_1", "_diff_1", "_slope_5")


def fit_winsor(train: DataFrame, cols: Sequence[str]) -> dict[str, ColumnState]:
    """P1/P99 (P0.1/P99.9 for change features), mean and population std of the finite training values."""
    clean = train.select(*[X.clean(F.col(c)).alias(c) for c in cols])
    probs = {c: [0.001, 0.999] if any(s in c for s in SENSITIVE) else [0.01, 0.99] for c in cols}
    q = fit_quantiles(clean, {c: (F.col(c), probs[c]) for c in cols})
    known = [c for c in cols if q[c][0] is not None]
    m = clean.agg(
        *[F.avg(c).alias(f"m_{c}") for c in known],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in known],
        *[F.stddev_pop(X.clip(F.col(c), *q[c])).alias(f"k_{c}") for c in known],
    ).first()
    return {c: ColumnState(q[c][0], q[c][1], m[f"m_{c}"], m[f"s_{c}"], m[f"k_{c}"]) for c in known}


def apply_winsor(df: DataFrame, state: Mapping[str, ColumnState]) -> DataFrame:
    """NULL/NaN to the mean, infinities to the bounds, everything inside the bounds."""

    def one(c: str, s: ColumnState) -> Column:
        x = F.col(c).cast("double")
        filled = F.when(x.isNull() | F.isnan(x), F.lit(s.mean)).otherwise(x)
        return X.clip(filled, s.low, s.high)

    return df.withColumns({c: one(c, s) for c, s in state.items()})


def fit_standard(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std; a constant column keeps scale 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def apply_standard(df: DataFrame, state: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in state.items()})


def fit_medians(train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return {c: q[0] for c, q in fit_quantiles(train, {c: (F.col(c), [0.5]) for c in cols}).items()}


def fill_with(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def min_max(df: DataFrame, col: str) -> Column:
    """(x - min) / (max - min + 1e-9) over the whole table, its range attached as one scalar."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    return (F.col(col) - span["lo"]) / (span["hi"] - span["lo"] + F.lit(1e-9))


def l2_normalise(v: Column) -> Column:
    """v / (|v| + 1e-8)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / (norm + 1e-8))
