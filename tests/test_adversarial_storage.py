"""Drift filters decide from bins where they can, and adversarial rounds store no features again."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting as B, drift, models as MO, splits


@pytest.fixture(scope="module")
def sides(spark):
    g = np.random.default_rng(2)
    n = 3000
    a = np.arange(n) % 3 > 0
    x = pd.DataFrame({"id": np.arange(n), "a": a, "same": g.normal(size=n), "moved": g.normal(size=n) + 0.3 * a, "ties": g.integers(0, 3, n) + (g.random(n) < 0.2 * a), "flat": 1.0, "gone": np.where(a, np.nan, 1.0)})
    df = spark.createDataFrame(x)
    return df.withColumn("gone", F.when(~F.isnan("gone"), F.col("gone"))).withColumn("odd", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 5 > 0, F.col("same")))


def test_bins_decide_as_the_whole_table(sides, monkeypatch):
    cols = ["same", "moved", "ties", "flat", "gone", "odd"]
    ks = {x.feature: x.ks_stat for x in drift.ks_table(sides, cols, F.col("a")).collect()}
    for limit in (0.0, ks["same"], ks["moved"], ks["moved"] - 1e-9, ks["ties"], ks["odd"] - 1e-9, 0.2):
        want = {c for c, v in ks.items() if v is not None and v <= limit}
        for bins in (4, 512):
            monkeypatch.setattr(drift, "KS_BINS", bins)
            assert drift.ks_within(sides, cols, F.col("a"), limit) == want, (limit, bins)


def test_features_are_not_stored_again(sides, monkeypatch):
    stored, cut = [], MO.cut_lineage

    def watched(df):
        out = cut(df)
        stored.append((len(df.columns), out.count()))
        return out

    monkeypatch.setattr(MO, "cut_lineage", watched)
    a, b = sides.where("a"), sides.where("NOT a")
    scored, _ = MO.adversarial_scores(a, b, ["same", "moved", "ties"], fit_rows=100)
    assert all(n < 400 for width, n in stored if width > 3)
    got = scored.toPandas()
    both = a.select("id", F.lit(0).alias("is_test")).unionByName(b.select("id", F.lit(1).alias("is_test")))
    want = splits.stratified_folds(both, "is_test", 3, "id").toPandas()
    assert got.sort_values("id").fold.tolist() == want.sort_values("id").fold.tolist() and got.p.between(0, 1).all()


def test_classifiers_are_fitted_on_all_rows(spark, monkeypatch):
    """More rows than any sample would take: every row of the other folds counts once in the root of every first tree."""
    seen, real = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.range(90_000).select("id", (F.xxhash64("id") % 100).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    a, b = df.where("id < 60000"), df.where("id >= 60000")
    scored, _ = MO.adversarial_scores(a, b, ["x", "z"], maxIter=1)
    assert scored.count() == 90_000
    assert [sums[0, j].sum() for sums in seen[0] for j in (0, 1)] == [60_000] * 6 and len(seen) == MO.TREE["maxDepth"]
    seen.clear()
    MO.prune_collective_drift(a, b, ["x", "z"], target_auc=0.0, rounds=2, maxIter=1)
    assert {sums[0, 0].sum() for sums in seen[0] + seen[-1]} == {60_000}


def test_sides_that_were_dealt_keep_their_folds(sides):
    a, b = (sides.where(x).select("id", "same", "moved") for x in ("a", "NOT a"))
    first, _ = MO.adversarial_scores(a, b, ["same", "moved"], maxIter=2)
    again, _ = MO.adversarial_scores(*MO.dealt(a, b), ["same", "moved"], maxIter=2)
    x, y = (s.toPandas().sort_values("id") for s in (first, again))
    assert x.fold.tolist() == y.fold.tolist() and np.allclose(x.p, y.p)
    same = MO.adversarial_auc(*MO.dealt(a, b), ["same", "moved"])[0]
    assert same == pytest.approx(MO.adversarial_auc(a, b, ["same", "moved"])[0])
