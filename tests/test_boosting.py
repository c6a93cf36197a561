"""Boosted trees grown side by side are those of ``pyspark.ml`` where both have the same bins, in a fixed number of passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting as B, models as MO
from panelforge.plans import modelling

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(1)
    n = 3000
    a, b, c = g.integers(0, 20, n) * 1.0, g.integers(0, 9, n) - 4.0, g.integers(0, 3, n) * 1.0
    y = np.exp(0.2 * a + 0.3 * b * c + 0.1 * g.normal(size=n))
    a[::50] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y, "w": 1.0 + (y > 10), "half": (np.arange(n) % 2) * 1.0})
    return spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None))).cache()


def test_trees_are_those_of_the_library(rows):
    cols = ["a", "b", "c"]
    kept = {"t": F.log1p("y"), "w": F.col("w"), "half": F.col("half"), "tail": (F.col("y") > 10).cast("double")}
    specs = [B.Spec(("a", "b", "c"), "t"), B.Spec(("a", "b", "c"), "t", "w"), B.Spec(("c", "a"), "t", "half"), B.Spec(("a", "b", "c"), "tail", loss="logistic"), B.Spec(("a", "b", "c"), "t", loss="squared")]
    mine = B.fit_all(rows, specs, kept)
    theirs = [MO.fit_regressor(rows, cols), MO.fit_regressor(rows, cols, weight="w"), MO.fit_regressor(rows.where("half = 1"), ["c", "a"]), MO.fit_classifier(rows.withColumn("tail", F.col("y") > 10), cols, "tail"), MO.fit_regressor(rows, cols, loss="squared")]
    for spec, m, t in zip(specs, mine, theirs):
        own = MO.probability if spec.loss == "logistic" else MO.predict
        both = own(t, rows, spec.cols, "p").withColumn("q", m.value()).toPandas()
        assert np.allclose(both.p, both.q, rtol=1e-9), spec
        imp = MO.importances(t, spec.cols)
        assert all(abs(imp[c] - v) < 1e-6 for c, v in m.importances().items())
    table = B.values_of_all(rows, mine, {"y": F.col("y"), "id": F.col("id")}).toPandas().sort_values("id")
    plain = rows.select("id", *[m.value().alias(f"p{i}") for i, m in enumerate(mine)]).toPandas().sort_values("id")
    assert all(np.allclose(table[f"p{i}"], plain[f"p{i}"]) for i in range(len(mine)))


@pytest.mark.parametrize("name, fits", [("m21_hyper_grid", 1), ("m23_label_threshold_sweep", 1), ("g20_feature_count_curve", 2), ("g11_cross_fold_gain_and_sign", 1)])
def test_passes_do_not_grow_with_the_models(spark, monkeypatch, name, fits):
    passes, real = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(MO, "fit_regressor", None)
    monkeypatch.setattr(MO, "fit_classifier", None)
    out = modelling.query.__globals__["REGISTRY"][name].build(spark, SF).collect()
    assert out and len(passes) == fits * MO.TREE["maxIter"] * MO.TREE["maxDepth"]


def test_root_cause_shares_deal_the_folds_once(spark, monkeypatch):
    dealt, real = [], MO.splits.stratified_folds
    monkeypatch.setattr(MO.splits, "stratified_folds", lambda *a: dealt.append(1) or real(*a))
    rows = {r.variant: r.auc for r in modelling.query.__globals__["REGISTRY"]["d24_drift_root_cause_shares"].build(spark, SF).collect()}
    assert set(rows) == {"full", "no_top_drift", "no_layout", "layout_only"} and len(dealt) == 1
