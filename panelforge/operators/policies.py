"""Blending, weighting and calibration of the two-model prediction, and sweeps over their settings.

A sweep is a set of expressions evaluated side by side in one aggregate pass: the rows are never multiplied by
the number of settings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions import exprs as X
from panelforge.operators.quantiles import fit_quantiles


def assemble(df: DataFrame, p: str = "p", tail: str = "t", bulk: str = "nt") -> DataFrame:
    """Add weight, gap and the blended prediction of a (p, tail, bulk) row; the bulk prediction stays as base."""
    gap = X.prediction_gap(F.col(tail), F.col(bulk))
    weight = X.blend_weight(F.col(p), F.col(tail), F.col(bulk)) * X.damping(F.col(p), gap)
    return df.withColumn("gap", gap).withColumn("weight", weight).withColumn("blended", X.blend(F.col("weight"), F.col(tail), F.col(bulk)))


def adversarial_weights(df: DataFrame, p: str, power: float = 1.0) -> DataFrame:
    """(p / (1 - p))^power, scaled to mean 1; certainty counts as 1 - 1e-6."""
    bounded = F.least(F.col(p), F.lit(1.0 - 1e-6))
    raw = df.withColumn("_odds", F.pow(bounded / (1.0 - bounded), F.lit(power)))
    mean = raw.agg(F.avg("_odds").alias("m")).scalar()
    return raw.withColumn("weight", F.col("_odds") / mean).drop("_odds")


def tail_weights(df: DataFrame, y: str, alpha: float = 0.5, cap: float = 5.0) -> DataFrame:
    """1 up to the 90th percentile, then growing with the excess in standard deviations, capped."""
    p90 = fit_quantiles(df, {"y": (F.col(y), [0.9])})["y"][0]
    sd = df.agg(F.stddev_pop(y).alias("s")).scalar()
    over = 1.0 + F.lit(alpha) * (F.col(y) - F.lit(p90)) / (sd + 1e-6)
    return df.withColumn("weight", X.clip(F.when(F.col(y) > p90, over).otherwise(F.lit(1.0)), 1.0, cap))


def fit_calibration(df: DataFrame, y: str, pred: str, cap: float = 1.5) -> dict[str, float]:
    """Means of both and the bounded ratio of their spreads, over rows with a prediction."""
    m = df.where(F.col(pred).isNotNull()).agg(F.avg(pred).alias("pm"), F.stddev_pop(pred).alias("ps"), F.avg(y).alias("tm"), F.stddev_pop(y).alias("ts")).first()
    return {"oof_mean": m.pm, "true_mean": m.tm, "std_scalar": min(cap, m.ts / (m.ps + 1e-9)), "mean_scalar": m.tm / (m.pm + 1e-9)}


def calibrate(pred: Column, state: Mapping[str, float]) -> Column:
    return (pred - F.lit(state["oof_mean"])) * F.lit(state["std_scalar"]) + F.lit(state["true_mean"])


def fold_ensemble(df: DataFrame, key: str, pred: str) -> DataFrame:
    """Mean prediction of each row over the folds that scored it."""
    return df.groupBy(key).agg(F.avg(pred).alias(pred), F.count(F.lit(1)).alias("n_folds"))


def expected_value(tail_flag: Column, y: Column, p: Column, tail: Column, bulk: Column) -> dict[str, Column]:
    """What attacking a row wins, what it costs, and the expectation p * gain - (1 - p) * cost."""
    better = F.abs(y - bulk) - F.abs(y - tail)
    gain, cost = F.when(tail_flag, better).otherwise(0.0), F.when(~tail_flag, -better).otherwise(0.0)
    return {"gain": gain, "cost": cost, "ev": p * gain - (1.0 - p) * cost}


def damped(p: Column, tail: Column, bulk: Column, power: float, threshold: float = 0.0) -> Column:
    """p^power share of the tail model where p reaches the threshold, the bulk model elsewhere."""
    w = F.pow(p, F.lit(float(power)))
    return F.when(p >= threshold, w * tail + (1.0 - w) * bulk).otherwise(bulk)


def blend_policies(p: Column, p_rank: Column, tail: Column, bulk: Column, p_mean: float, p_std: float, max_delta: float) -> dict[str, Column]:
    """The named ways of turning probability and two predictions into one."""
    d = tail - bulk
    bounded = X.clip(d, -max_delta, max_delta)
    sharp = 1.0 / (1.0 + F.exp(-10.0 * (p - 0.3)))
    boundary = (p >= 0.2) & (p <= 0.4)
    return {
        "expected_value": p * tail + (1.0 - p) * bulk,
        "risk_adjusted": bulk + p * p * d,
        "meta_gate": F.when(p > 0.4, tail).otherwise(bulk),
        "sharpening": bulk + sharp * sharp * d,
        "soft_top_k": bulk + F.pow(p_rank, F.lit(5.0)) * d,
        "conditional_clip": bulk + p * p * F.when(p < 0.4, bounded).otherwise(d),
        "asymmetric_clip": bulk + p * p * F.when(d > 0, F.least(d, F.lit(max_delta))).otherwise(d),
        "z_normalised": bulk + X.clip((p - p_mean) / (p_std + 1e-9), 0.0, 1.0) * d,
        "rank_weight": bulk + p_rank * d,
        "boundary_suppression": F.when(boundary, bulk).otherwise(bulk + p * p * d),
        "boundary_attenuation": bulk + F.when(boundary, 0.3).otherwise(1.0) * p * p * d,
        "residual_clip": bulk + p * p * bounded,
    }


def regime_blend(regime: Column, tail: Column, bulk: Column, theta: float, temperature: float, tail_share: float, penalty: float = 1.0) -> Column:
    """Logistic routing by regime between the bulk model and a (penalised) mix of both."""
    share = 1.0 / (1.0 + F.exp(-(regime - F.lit(theta)) / F.lit(temperature)))
    mixed = (F.lit(tail_share) * tail + F.lit(1.0 - tail_share) * bulk) * F.lit(penalty)
    return share * mixed + (1.0 - share) * bulk
