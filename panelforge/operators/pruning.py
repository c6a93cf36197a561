"""Pruning fitted on one side: nulls, redundancy and variance, each step on the columns that the step before left."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelforge.operators import drift, features as FE, selection as SE, tables as TB
from panelforge.session import cut_lineage


@dataclass
class Pruning:
    """Decisions of a fit: ``manifest`` to apply to other rows, ``records`` of what went and why, ``representatives`` of each cluster."""

    manifest: SE.Manifest
    records: DataFrame
    representatives: DataFrame


def metadata(table: DataFrame) -> DataFrame:
    """A table of one row per column of a schema, computed once."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def fit_pruning(train: DataFrame, cols: Sequence[str], protected: Sequence[str] = (), importance: Callable[[DataFrame, list[str]], Mapping[str, float]] | None = None) -> Pruning:
    """Fit all drops on the rows of ``train`` alone: null ratios beyond their gap, then all but the representative of each cluster of
    correlated columns, then variances below their floor.

    ``importance`` ranks the members of a cluster from the rows (nulls filled with medians) and the columns still there; without it the
    variance does. Equal ranks go to the first name. A column without any value correlates with nothing; an empty table drops nothing.
    """
    spark, guarded = train.sparkSession, list(protected)
    train = cut_lineage(train)
    ratios = metadata(drift.stats_long(train, list(cols), ratio=lambda c: F.avg(c.isNull().cast("double"))))
    gap = SE.gap_threshold(ratios).first()
    nulls = metadata(SE.drop_records(ratios, "ratio", F.lit(gap.threshold), "nan_drop", "null gap" if gap.gap_found else "fallback", guarded))
    drop_nan = [x.feature for x in nulls.collect()]

    left = [c for c in cols if c not in set(drop_nan)]
    medians = {c: m for c, m in FE.fit_medians(train, left).items() if m is not None}
    filled = cut_lineage(FE.fill_with(train, medians))
    strength = np.nan_to_num(np.abs(TB.correlation_matrix(filled, left)))
    np.fill_diagonal(strength, 0.0)
    cut = SE.redundancy_cut(np.clip(1.0 - strength, 0.0, 1.0))
    if importance is None:
        ranks = {x.feature: x.variance for x in drift.stats_long(filled, left, variance=F.var_samp).collect()}
    else:
        ranks = importance(filled, left)
    ranked = spark.createDataFrame([(c, float(ranks.get(c) or 0.0)) for c in left], "feature string, importance double")
    representatives = metadata(SE.representatives(SE.cluster_table(spark, left, strength, cut), ranked, guarded))
    drop_corr = [x.feature for x in representatives.where("NOT kept").collect()]
    most = dict(zip(left, strength.max(1).tolist()))
    redundant = spark.createDataFrame([(c, "corr_drop", most[c], cut, "Q1 of distances") for c in drop_corr], nulls.schema)

    left = [c for c in left if c not in set(drop_corr)]
    variances = metadata(drift.stats_long(train, left, variance=F.var_samp))
    floor = variances.agg(SE.variance_floor(variances).alias("floor")).first().floor
    flat = metadata(SE.drop_records(variances, "variance", F.lit(floor), "variance_drop", "P1 of variances", guarded, below=True))
    drop_var = [x.feature for x in flat.collect()]
    manifest = SE.Manifest(nan_threshold=gap.threshold, corr_threshold=cut, var_threshold=floor, drop_nan=drop_nan, drop_corr=drop_corr, drop_var=drop_var)
    return Pruning(manifest, nulls.unionByName(redundant).unionByName(flat), representatives)
