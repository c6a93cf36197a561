"""Whole-table checks: kinds, duplicates, snapshots, fingerprints, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions import exprs as X
from panelforge.operators.prefix import melt, value_counts


def infer_kinds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, kind, n_unique, low, high): count, ratio or sensor, from cardinality, range and integer-ness.

    Distinct values are counted from the (feature, value) table all columns share, not with one
    count-distinct per column, which would multiply every row by the number of columns.
    """
    values = value_counts(melt(df, [], list(cols)), ["feature"], "value")
    stats = values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.bool_and(F.col("value") % 1 == 0).alias("whole"),
    )
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    few = F.col("n_unique") < F.least(F.lit(100.0), total * 0.1)
    unit = (F.col("low") >= -1e-5) & (F.col("high") <= 1.00001) & (F.col("n_unique") > 10)
    kind = F.when(F.col("whole") & few, "count").when(unit, "ratio").otherwise("sensor")
    return stats.select("feature", kind.alias("kind"), "n_unique", "low", "high")


def fit_kinds(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The same as driver-side state, one entry per column; all-NULL columns count as sensors."""
    found = {r.feature: r.kind for r in infer_kinds(df, cols).select("feature", "kind").collect()}
    return {c: found.get(c, "sensor") for c in cols}


def duplicate_counts(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rows beyond the first of each identical group, exactly and after rounding the numeric columns."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    rounded = df.select(*[F.round(F.col(c), digits).alias(c) if c in numeric else F.col(c) for c in df.columns])
    exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"))
    near = rounded.groupBy(*numeric).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("d")).scalar()
    out = exact.withColumn("near_duplicates", near)
    return out.withColumn("risk_status", F.when(F.col("near_duplicates") > 0, "HIGH").otherwise("SAFE"))


def snapshot(df: DataFrame) -> DataFrame:
    """(dtype, n_columns, n_rows, n_null): the table's shape by column type."""
    kinds = sorted({t for _, t in df.dtypes})
    nulls = {k: sum((F.count_if(F.col(c).isNull()) for c, t in df.dtypes if t == k), F.lit(0)) for k in kinds}
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[v.cast("long").alias(f"null_{i}") for i, v in enumerate(nulls.values())])
    cells = [
        F.struct(
            F.lit(k).alias("dtype"),
            F.lit(sum(1 for _, t in df.dtypes if t == k)).cast("long").alias("n_columns"),
            F.col("_n").alias("n_rows"),
            F.col(f"null_{i}").alias("n_null"),
        )
        for i, k in enumerate(kinds)
    ]
    return wide.select(F.inline(F.array(*cells)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes when the content does and not when only the row order does."""
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(
        F.lit(",".join(f"{c}:{t}" for c, t in df.dtypes)).alias("schema"),
        F.count(F.lit(1)).alias("row_count"),
        sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("null_count"),
        F.sum(row_hash.cast("decimal(38,0)")).cast("string").alias("content_sum"),
        F.bit_xor(row_hash).alias("content_xor"),
    )


#: Up to so many pairs of columns are side-by-side aggregates; more columns take one pass of matrix products. Both follow one rule.
PAIRS_AT_ONCE = 800


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr) for a < b, over the rows where both are known; a constant column has NULL correlation."""
    pairs = list(combinations(cols, 2))
    if len(pairs) <= PAIRS_AT_ONCE:
        wide = df.agg(*[X.corr(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)] or [F.lit(None)])
        cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
        return wide.select(F.inline(F.array(*cells))) if cells else df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    m = correlation_matrix(df, cols)
    rows = [(a, b, None if np.isnan(m[i, j]) else float(m[i, j])) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def _masked_products(means: list[float]):
    """Per task and column i: for each column j the rows where both are known, and over these the sums of x_i, x_i ** 2 and x_i * x_j."""

    def run(batches):
        p = len(means)
        total = np.zeros((4, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64, na_value=np.nan) - np.array(means)
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(np.float64)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pd.DataFrame({"i": np.arange(p), **{n: [r.tolist() for r in t] for n, t in zip("nsqx", total)}})

    return run


def correlation_matrix(df: DataFrame, cols: Sequence[str]):
    """p x p numpy matrix of Pearson correlations over the rows where both columns are known; NaN where there is none.

    One pass whatever the number of columns; the driver gets p * p sums.
    """
    cols = list(cols)
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = [v or 0.0 for v in narrow.agg(*[F.avg(c).alias(c) for c in cols]).first()]
    parts = narrow.mapInPandas(_masked_products(means), "i int, n array<double>, s array<double>, q array<double>, x array<double>")
    cells = parts.select("i", F.posexplode(F.arrays_zip("n", "s", "q", "x")).alias("j", "v")).groupBy("i", "j")
    n, s, q, x = (np.zeros((len(cols), len(cols))) for _ in range(4))
    for r in cells.agg(*[F.sum(f"v.{c}").alias(c) for c in "nsqx"]).collect():
        n[r.i, r.j], s[r.i, r.j], q[r.i, r.j], x[r.i, r.j] = r.n, r.s, r.q, r.x
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n  # of column i over the rows where j is known too
        spread[spread <= 1e-12 * q] = np.nan
        out = (x - s * s.T / n) / np.sqrt(spread * spread.T)
    return out


def counts_by(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
