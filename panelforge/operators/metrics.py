"""Prediction metrics and the verdicts built on them.  Rows without a prediction never count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge.operators import ranks
from panelforge.operators.quantiles import fit_quantiles

BANDS = {"Q0_50": (0.0, 0.5), "Q50_90": (0.5, 0.9), "Q90_99": (0.9, 0.99), "Q99_100": (0.99, 1.0)}
EPS = 1e-9


def with_errors(df: DataFrame, y: str, pred: str, base: str | None = None) -> DataFrame:
    """(_y, _p, _e[, _b]), all NULL where there is no prediction; aggregates skip NULL, so no filter is needed
    (one on a computed prediction would be pushed down and compute it twice)."""
    known = F.col(pred).isNotNull()
    cols = [F.when(known, F.col(y)).alias("_y"), F.col(pred).alias("_p"), F.abs(F.col(y) - F.col(pred)).alias("_e")]
    if base:
        cols.append(F.when(known, F.abs(F.col(y) - F.col(base))).alias("_b"))
    return df.select(*cols)


def _no_predictions(spark: SparkSession, with_base: bool) -> DataFrame:
    """All metrics as zeros, in the columns of ``build_metrics``."""
    names = ["mae", "rmse", "med_ae", "mean_ratio", "std_ratio", "mae_bottom_50", "mae_top_10", "mae_top_1", "p50_ratio", "p90_ratio", "p99_ratio"]
    names += [f"{b}_mae" for b in BANDS] + (["fp_cost", "gain_capture"] if with_base else [])
    return spark.range(1).select(*[F.lit(0.0).alias(n) for n in names])


def build_metrics(df: DataFrame, y: str, pred: str, base: str | None = None) -> DataFrame:
    """One row: error, distribution-ratio, error-tail, target-band and (given a base prediction) blend metrics.

    Without any prediction all metrics are zero. Two passes: quantiles first, then every conditional mean in a single aggregate.
    """
    rows = with_errors(df, y, pred, base)
    n = rows.agg(F.count("_e")).first()[0]
    if not n:
        return _no_predictions(df.sparkSession, base is not None)
    half = n // 2
    ys, ps = [0.0, 0.5, 0.9, 0.99, 1.0], [0.5, 0.9, 0.99]
    at_half = (half - 1) / (n - 1) if half and n > 1 else 0.0
    q = fit_quantiles(rows, {"y": (F.col("_y"), ys), "p": (F.col("_p"), ps), "e": (F.col("_e"), [0.5, 0.9, 0.99, at_half])})
    qy = dict(zip(ys, q["y"]))
    e, p, t = F.col("_e"), F.col("_p"), F.col("_y")
    kth = q["e"][3]
    below = e < kth
    out = {
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "med_ae": F.lit(q["e"][0]),
        "mean_ratio": F.avg(p) / (F.avg(t) + EPS),
        "std_ratio": F.stddev_pop(p) / (F.stddev_pop(t) + EPS),
        "mae_bottom_50": (F.coalesce(F.sum(F.when(below, e)), F.lit(0.0)) + (F.lit(half) - F.count_if(below)) * F.lit(kth)) / F.lit(max(half, 1)),
        "mae_top_10": F.avg(F.when(e >= q["e"][1], e)),
        "mae_top_1": F.avg(F.when(e >= q["e"][2], e)),
    }
    for prob, v in zip(ps, q["p"]):
        out[f"p{round(prob * 100)}_ratio"] = F.lit(v / (qy[prob] + EPS))
    for name, (lo, hi) in BANDS.items():
        inside = (t >= qy[lo]) & (t <= qy[hi])  # both ends belong to the band
        out[f"{name}_mae"] = F.coalesce(F.avg(F.when(inside, e)), F.lit(0.0))
    if base:
        b = F.col("_b")
        out["fp_cost"] = F.coalesce(F.avg(F.when(e > b, e - b)), F.lit(0.0))
        out["gain_capture"] = F.sum(F.greatest(F.lit(0.0), b - e)) / (F.sum(b) + EPS)
    return rows.agg(*[c.alias(k) for k, c in out.items()])


def fold_maes(df: DataFrame, fold: str, y: str, pred: str) -> DataFrame:
    return df.groupBy(fold).agg(F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae")).where("mae IS NOT NULL")


def fold_spread(maes: DataFrame) -> DataFrame:
    """(cv_mean, cv_std, n): population spread of the fold errors."""
    return maes.agg(F.avg("mae").alias("cv_mean"), F.stddev_pop("mae").alias("cv_std"), F.count(F.lit(1)).alias("n"))


def risk_parts() -> dict[str, Column]:
    """Risk components of a metrics row that also holds adv_auc, cv_mean and cv_std."""
    parts = {
        "divergence": F.col("cv_std") / (F.col("cv_mean") + EPS) * 10.0,
        "adversarial": F.greatest(F.lit(0.0), F.col("adv_auc") - 0.5) * 8.0,
        "distribution": F.abs(1.0 - F.col("std_ratio")) * 4.0 + F.abs(1.0 - F.col("mean_ratio")) * 2.0,
        "tail": F.col("Q99_100_mae") / F.col("mae") * 0.2,
    }
    total = parts["divergence"] + parts["adversarial"] + parts["distribution"] + parts["tail"]
    return parts | {"total": total}


def reliability(adv_auc: Column, std_ratio: Column, mean_ratio: Column) -> dict[str, Column]:
    """How far a validation score can be trusted: 1 / (1 + penalties), and the reading of it."""
    # Weights, limits and words of the reading.
    adversarial = F.greatest(F.lit(0.0), (adv_auc - 0.5) / 0.5) * 1.5
    variance = F.greatest(F.lit(0.0), 1.0 - std_ratio)
    bias = F.abs(1.0 - mean_ratio) * 0.5
    score = 1.0 / (1.0 + adversarial + variance + bias)
    reading = F.when(score > 0.7, "RELIABLE").when(score > 0.4, "PARTIAL").otherwise("UNRELIABLE")
    return {"adversarial_penalty": adversarial, "variance_penalty": variance, "bias_penalty": bias, "reliability_score": score, "interpretation": reading}


def _index(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * 100.0))


def risk_indices() -> dict[str, Column]:
    """Nine indices in [0, 100] of a metrics row with adv_auc, cv_mean, cv_std and total risk."""
    # Names, offsets and scales of the indices.
    auc, std, mean, p99 = F.col("adv_auc"), F.col("std_ratio"), F.col("mean_ratio"), F.col("p99_ratio")
    return {
        "external_drift": _index((auc - 0.7) / 0.3),
        "global_bias": _index(F.abs(1.0 - mean) / 0.3),
        "variance_compression": _index((1.0 - std) / 0.5),
        "cv_reliability": _index(F.coalesce(F.try_divide(F.col("cv_std"), F.col("cv_mean")), F.lit(0.0)) / 0.2),
        "tail_residual": _index((1.0 - p99) / 0.7),
        "prediction_cap": _index((0.5 - p99) / 0.2),
        "feature_blindness": _index((F.col("mae_top_1") / (F.col("mae") + EPS) - 5) / 10),
        "temporal_discontinuity": _index((auc - 0.9) / 0.1),
        "generalisation_gap": _index(F.col("total") / 10.0),
    }


def execution_verdict(fp_cost: Column, gain_capture: Column) -> Column:
    # Limits and words of the verdict.
    return F.when(fp_cost > 1.0, "OVER-AGGRESSIVE").when(gain_capture < 0.05, "TOO CAUTIOUS").otherwise("OPTIMIZED")


def pr_summary(df: DataFrame, score: str, label: Column, group: Sequence[str] = ()) -> DataFrame:
    """Trapezoid PR-AUC, average precision and the score with the best F1."""
    pts = ranks.pr_points(df, group, score, label)
    step = F.col("recall") - F.col("prev_recall")
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS)
    return pts.groupBy(*group).agg(
        F.sum(step * (F.col("precision") + F.col("prev_precision")) / 2).alias("pr_auc"),
        F.sum(step * F.col("precision")).alias("average_precision"),
        F.max(f1).alias("best_f1"),
        F.max_by(F.col(score), F.struct(F.round(f1, 12), F.col(score))).alias("best_threshold"),
    )


def segment_report(df: DataFrame, segment: Column, y: str = "y", pred: str = "oof") -> DataFrame:
    """(segment, n, mae, bias, share of total error) per non-NULL segment."""
    e = F.abs(F.col(y) - F.col(pred))
    per = df.groupBy(segment.alias("segment")).agg(
        F.count(e).alias("n"), F.avg(e).alias("mae"), F.avg(F.col(pred) - F.col(y)).alias("bias"), F.sum(e).alias("_s")
    )
    total = per.agg(F.sum("_s").alias("s")).scalar()
    return per.where(F.col("segment").isNotNull() & (F.col("n") > 0)).withColumn("share", F.col("_s") / total).drop("_s")


def policy_table(df: DataFrame, policies: Mapping[str, Column], **measures) -> DataFrame:
    """One row per policy from one pass: ``measures`` map a name to a function of the policy's prediction column."""
    wide = df.agg(*[f(c).alias(f"{i}_{m}") for i, c in enumerate(policies.values()) for m, f in measures.items()])
    cells = [F.struct(F.lit(n).alias("method"), *[F.col(f"{i}_{m}").alias(m) for m in measures]) for i, n in enumerate(policies)]
    return wide.select(F.inline(F.array(*cells)))
