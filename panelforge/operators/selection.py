"""Choosing features: thresholds, clusters, gates and the registry of what was dropped and why.

Statistics are computed on Spark over all rows.  What the rules below read is feature metadata, one row per
column of the schema (hundreds), so windows over it and small driver loops do not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec, functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X, names as N
from panelforge.operators.prefix import melt

def everything() -> WindowSpec:
    """All rows of a metadata table as one window."""
    return W.partitionBy(F.lit(0))


def gap_threshold(ratios: DataFrame, fallback: float = 0.50) -> DataFrame:
    """Cut-off on a (feature, ratio) table: the largest jump between sorted ratios, if it exceeds mean + 2 std of the
    jumps and lies above the median; else ``fallback``."""
    ordered = everything().orderBy("ratio", "feature")
    jumps = ratios.withColumn("jump", F.col("ratio") - F.lag("ratio").over(ordered))
    s = jumps.agg(
        F.max("jump").alias("largest"),
        (F.avg("jump") + 2 * F.stddev_samp("jump")).alias("significant"),
        F.max_by("ratio", F.struct(F.round("jump", 12), -F.col("ratio"))).alias("at"),
        (F.percentile("ratio", F.lit(0.5)) + 1e-6).alias("floor"),
    )
    found = (F.col("largest") > F.col("significant")) & (F.col("at") > F.col("floor"))
    return s.select(F.when(found, F.col("at")).otherwise(F.lit(fallback)).alias("threshold"), F.coalesce(found, F.lit(False)).alias("gap_found"))


def variance_floor(variances: DataFrame) -> Column:
    """max(float32 epsilon, P1 of the variances) of a (feature, variance) table, as a scalar."""
    return variances.agg(F.greatest(F.lit(X.FLOAT32_EPS), F.percentile("variance", F.lit(0.01))).alias("t")).scalar()


def drop_records(metric: DataFrame, stat: str, threshold: Column, reason: str, derivation: str, protected: Sequence[str] = (), below: bool = False) -> DataFrame:
    """(feature, reason, stat_value, threshold, derivation) of unprotected features beyond the threshold."""
    beyond = F.col("stat_value") < F.col("threshold") if below else F.col("stat_value") > F.col("threshold")
    return (
        metric.select("feature", F.lit(reason).alias("reason"), F.col(stat).cast("double").alias("stat_value"), threshold.cast("double").alias("threshold"), F.lit(derivation).alias("derivation"))
        .where(beyond & ~F.col("feature").isin(list(protected)))
    )


@dataclass
class Manifest:
    """Training decisions, applied to other rows unchanged."""

    nan_threshold: float = 0.5
    corr_threshold: float = 0.15
    var_threshold: float = 0.0
    drop_nan: list[str] = field(default_factory=list)
    drop_corr: list[str] = field(default_factory=list)
    drop_var: list[str] = field(default_factory=list)
    train_means: dict[str, float] = field(default_factory=dict)
    bin_edges: dict[str, list[float]] = field(default_factory=dict)
    extremes: dict[str, float] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def dropped(self) -> set[str]:
        return {*self.drop_nan, *self.drop_corr, *self.drop_var}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in self.dropped()])


class SchemaMismatch(RuntimeError):
    pass


def sync_schema(df: DataFrame, expected: Iterable[str], ids: Iterable[str], dropped: Iterable[str] = (), allow_extra: bool = True) -> DataFrame:
    """Keep exactly the expected features not dropped on record; fail when one is missing (or, if asked, extra)."""
    want = [c for c in expected if c not in set(dropped)]
    have = [c for c in df.columns if c not in set(ids)]
    missing, extra = sorted(set(want) - set(have)), sorted(set(have) - set(want))
    if missing or (extra and not allow_extra):
        raise SchemaMismatch(f"missing {missing}, unexpected {extra}")
    return df.select(*[c for c in df.columns if c in set(ids)], *want)


def protected_children(lineage: DataFrame, ks: DataFrame, threshold: Column) -> DataFrame:
    """(child, protected): a derived feature is protected while no parent's KS exceeds the threshold."""
    k = ks.select(F.col("feature").alias("parent"), "ks_stat")
    calm = F.coalesce(F.col("ks_stat"), F.lit(0.0)) <= threshold
    return lineage.join(k, "parent", "left").groupBy("child").agg(F.bool_and(calm).alias("protected"))


# --- redundancy -----------------------------------------------------------------------------------------------


def linkage_clusters(distance: np.ndarray, cut: float, method: str = "average") -> list[int]:
    """Flat cluster number per column from a p x p distance matrix, merging while the linkage distance is <= cut.

    The matrix comes from an aggregate over all rows; only this p x p step runs on the driver.
    """
    p = len(distance)
    members = {i: [i] for i in range(p)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = np.ones(p, dtype=bool)
    while alive.sum() > 1:
        masked = np.where(alive[:, None] & alive[None, :], d, np.inf)
        i, j = np.unravel_index(np.argmin(masked), masked.shape)
        if masked[i, j] > cut:
            break
        a, b = len(members[i]), len(members[j])
        merged = (a * d[i] + b * d[j]) / (a + b) if method == "average" else np.maximum(d[i], d[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        members[i] += members.pop(j)
        alive[j] = False
    label = [0] * p
    for k, group in enumerate(sorted(members.values(), key=min)):
        for m in group:
            label[m] = k
    return label


def redundancy_cut(distance: np.ndarray) -> float:
    """Q1 of the nonzero pairwise distances, kept inside [0.02, 0.20]; 0.15 when there are too few."""
    upper = distance[np.triu_indices(len(distance), 1)]
    nonzero = upper[upper > 1e-10]
    return float(np.clip(np.percentile(nonzero, 25), 0.02, 0.20)) if len(nonzero) >= 4 else 0.15


def cluster_table(spark: SparkSession, cols: Sequence[str], corr: np.ndarray, cut: float | None = None, method: str = "average") -> DataFrame:
    """(feature, cluster) from the absolute correlation matrix."""
    distance = np.clip(1.0 - np.nan_to_num(np.abs(corr)), 0.0, 1.0)
    labels = linkage_clusters(distance, redundancy_cut(distance) if cut is None else cut, method)
    return spark.createDataFrame(list(zip(cols, labels)), "feature string, cluster int")


def representatives(clusters: DataFrame, importance: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """(feature, cluster, kept): protected members stay; a cluster without any keeps its most important member."""
    shielded = F.col("feature").isin(list(protected))
    scored = clusters.join(importance, "feature", "left").fillna(0.0, ["importance"])
    group = W.partitionBy("cluster")
    best = F.row_number().over(group.orderBy(F.desc("importance"), "feature")) == 1
    any_shielded = F.bool_or(shielded).over(group)
    return scored.select("feature", "cluster", F.when(any_shielded, shielded).otherwise(best).alias("kept"))


def greedy_uncorrelated(ordered: Sequence[str], corr: Mapping[tuple[str, str], float], limit: float = 0.95) -> list[str]:
    """Walk features from the best down, dropping whatever correlates above ``limit`` with one already kept."""
    kept: list[str] = []
    dropped: set[str] = set()
    for f in ordered:
        if f in dropped:
            continue
        kept.append(f)
        dropped |= {g for g in ordered if g != f and (corr.get((f, g)) or corr.get((g, f)) or 0.0) > limit}
    return kept


# --- gates --------------------------------------------------------------------------------------------------


def feature_log(rows: DataFrame, cols: Sequence[str], ks: DataFrame, y: str = "y", half: str = "half", gain_scale: float = 100.0) -> DataFrame:
    """Per feature: gain, permutation stand-in, marginal correlation, and their stability over two halves.

    All of it is correlations of the long form, so one aggregate serves any number of features.
    """
    centre = rows.agg(F.avg(y).alias("m")).scalar()
    long = melt(rows.withColumn("_spread", F.abs(F.col(y) - centre)), [y, half, "_spread"], cols)
    v, t = F.col("value"), F.col(y)
    per = long.groupBy("feature").agg(
        X.corr(v, t).alias("marg_corr"),
        X.corr(v, F.col("_spread")).alias("spread_corr"),
        X.corr(v, F.when(F.col(half) == 0, t)).alias("c0"),
        X.corr(v, F.when(F.col(half) == 1, t)).alias("c1"),
    )
    g0, g1 = F.abs("c0") * gain_scale, F.abs("c1") * gain_scale
    mean, std = (g0 + g1) / 2, F.abs(g0 - g1) / 2
    return per.join(ks.select("feature", "ks_stat"), "feature", "left").select(
        "feature",
        (F.abs("marg_corr") * gain_scale).alias("gain"),
        (F.abs("spread_corr") * 0.05).alias("perm_delta"),
        (F.abs("spread_corr") * 0.05 / (F.abs("marg_corr") * gain_scale + 1e-9)).alias("gen_ratio"),
        "marg_corr",
        F.coalesce("ks_stat", F.lit(0.0)).alias("ks_stat"),
        F.when(mean > 0, std / (mean + 1e-9)).otherwise(1.0).alias("gain_cv"),
        (F.abs(F.signum("c0") + F.signum("c1")) / 2).alias("sign_stability"),
        F.col("feature").startswith("__noise_").alias("is_noise"),
    )


# Limits of the gates. Category -> (multiplier of the noise ceiling, least permutation delta).
CEILING = {"complex": (1.0, 0.001), "plain": (1.5, 0.002)}
GAIN_OVER_NOISE, GAIN_QUANTILE = 1.2, 0.2
KS_QUANTILE, KS_BOUNDS = 0.9, (0.10, 0.25)
SIGNAL_DELTA, STABLE_SIGN, CLEAR_DELTA, INTERACTION_DELTA = 0.001, 0.66, 0.004, 0.001
#: Name prefixes of derived pair features; those of the second group get half the floor.
PAIR_PREFIXES, HALF_FLOOR_PREFIXES = ("inter_", "ratio_", "diff_", "logprod_"), ("ratio_", "diff_")


def _any_prefix(f: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, [f.startswith(p) for p in prefixes])


def gate(log: DataFrame, inter_mult: float = 1.0, inter_floor: float = 1.0) -> DataFrame:
    """Noise, signal, drift and interaction gates over a feature log; the limits come from the log's own noise and quantiles.

    A feature passes when every gate holds; ``rejection_reasons`` names those that do not, in the order of the gates.
    """
    whole, f, delta = everything(), F.col("feature"), F.col("perm_delta")
    of = lambda noise, c: F.when(F.col("is_noise") == noise, F.col(c))
    limits = {
        "_gain": F.greatest(F.coalesce(F.max(of(True, "gain")).over(whole), F.lit(0.0)) * GAIN_OVER_NOISE, F.percentile(of(False, "gain"), F.lit(GAIN_QUANTILE)).over(whole)),
        "_perm": F.coalesce(F.max(of(True, "perm_delta")).over(whole), F.lit(0.0)),
        "_ks": F.least(F.greatest(F.percentile(of(False, "ks_stat"), F.lit(KS_QUANTILE)).over(whole), F.lit(KS_BOUNDS[0])), F.lit(KS_BOUNDS[1])),
    }
    by_kind = lambda k: F.when(N.is_complex(f), CEILING["complex"][k]).otherwise(CEILING["plain"][k])
    pair = _any_prefix(f, PAIR_PREFIXES)
    ceiling = F.col("_perm") * by_kind(0) * F.when(pair, inter_mult).otherwise(1.0)
    floor = by_kind(1) * F.when(pair, inter_floor).otherwise(1.0) * F.when(_any_prefix(f, HALF_FLOOR_PREFIXES), 0.5).otherwise(1.0)
    beats = {"beats_noise_gain": F.col("gain") > F.col("_gain"), "beats_noise_perm": delta > F.greatest(ceiling, floor)}
    gates = {
        "NoiseCeiling": beats["beats_noise_gain"] | beats["beats_noise_perm"],
        "SignInstability": (delta > F.greatest(F.col("_perm"), F.lit(SIGNAL_DELTA))) & ((F.col("sign_stability") >= STABLE_SIGN) | (delta > CLEAR_DELTA)),
        "DriftRisk": F.col("ks_stat") <= F.col("_ks"),
        "RedundantInteraction": ~f.startswith("inter_") | (delta > INTERACTION_DELTA),
    }
    failed = F.filter(F.array(*[F.when(~ok, reason) for reason, ok in gates.items()]), lambda x: x.isNotNull())
    return log.withColumns(limits).where(~F.col("is_noise")).select(
        *log.columns,
        *[c.alias(n) for n, c in beats.items()],
        reduce(lambda x, y: x & y, gates.values()).alias("passed"),
        failed.alias("rejection_reasons"),
        N.has_any(f, ("_rate_", "_slope_", "_diff_", "_std_", "_volatility_")).alias("is_trend_vol"),
    )


def rank_score(survivors: DataFrame) -> DataFrame:
    """gain rank + permutation rank + 3 x stability rank, each a tie-averaged share of the survivors."""

    def pct(order: Column, tie: str) -> Column:
        n = F.count(F.lit(1)).over(everything())
        return (F.rank().over(everything().orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(tie)) - 1) / 2.0) / n

    score = pct(F.asc("gain"), "gain") + pct(F.asc("perm_delta"), "perm_delta") + 3.0 * pct(F.desc("ks_stat"), "ks_stat")
    return survivors.withColumn("score", score)
