"""Properties of the fitted models: signal is found, noise is not, drift is seen and removed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import models as MO, ranks
from panelforge.operators.quantiles import fit_quantiles
from panelforge.plans import modelling
from panelforge.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(0)
    n = 1500
    a, b = g.normal(size=n), g.normal(size=n)
    y = np.exp(1 + 0.8 * a + 0.1 * g.normal(size=n))
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "y": y, "shifted": g.normal(size=n) + (np.arange(n) >= 900) * 3.0})
    return cut_lineage(spark.createDataFrame(pdf))


def test_two_stage_beats_the_mean_and_survives_saving(rows, tmp_path):
    train, test = rows.where("id < 1000"), rows.where("id >= 1000")
    m = MO.fit_two_stage(train, ["a", "b"])
    scored = m.score(test)
    mean = train.agg(F.avg("y")).first()[0]
    assert MO.mae(scored, "y", "blended") < 0.5 * test.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    auc = ranks.roc_auc(scored, [], "p", F.col("y") >= m.q90).first().auc
    assert auc > 0.95
    m.save(str(tmp_path))
    again = m.restored(str(tmp_path)).score(test)
    a = scored.select("id", "blended").toPandas().sort_values("id").blended
    b = again.select("id", "blended").toPandas().sort_values("id").blended
    assert np.allclose(a, b)


def test_adversarial_auc_sees_drift_and_pruning_removes_it(rows):
    a, b = rows.where("id < 900"), rows.where("id >= 900")
    auc, imp = MO.adversarial_auc(a, b, ["a", "b", "shifted"], folds=2)
    assert auc > 0.9 and max(imp, key=imp.get) == "shifted"
    kept, history, reached = MO.prune_collective_drift(a, b, ["a", "b", "shifted"], target_auc=0.65, folds=2)
    assert "shifted" not in kept and history[-1][1] <= 0.65
    protected, _, _ = MO.prune_collective_drift(a, b, ["a", "b", "shifted"], target_auc=0.65, folds=2, rounds=1, protected=["shifted"], enforce_protection=True)
    assert "shifted" in protected


def test_same_side_cannot_be_told_apart(rows):
    auc, _ = MO.adversarial_auc(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["a", "b"], folds=2)
    assert abs(auc - 0.5) < 0.08


def test_noise_earns_less_than_signal(rows):
    noisy = cut_lineage(rows.withColumns(MO.noise_columns(3)))
    cols = ["a", "b", *MO.noise_columns(3)]
    imp = MO.importances(MO.fit_regressor(noisy, cols), cols)
    assert imp["a"] > 5 * max(v for c, v in imp.items() if c.startswith("__noise_"))


def test_shuffling_the_signal_hurts(rows):
    m = MO.fit_regressor(rows, ["a", "b"])
    d = MO.permutation_importance(m, rows, ["a", "b"], {"a": ["a"], "b": ["b"]})
    assert d["a"] > 10 * abs(d["b"])
    shuffled = MO.shuffle_columns(rows, ["a"]).select("id", "a", "b").toPandas().sort_values("id")
    original = rows.select("id", "a", "b").toPandas().sort_values("id")
    assert np.allclose(sorted(shuffled.a), sorted(original.a)) and np.allclose(shuffled.b, original.b)
    assert not np.allclose(shuffled.a, original.a)


def test_isotonic_is_monotone_and_clipped(rows):
    q = fit_quantiles(rows, {"y": (F.col("y"), [0.9])})["y"][0]
    data = rows.withColumn("p", 1 / (1 + F.exp(-F.col("a")))).withColumn("tail", F.col("y") >= q)
    cal = MO.isotonic(data, "p", "tail").transform(data).toPandas().sort_values("p")
    assert (np.diff(cal.p_cal) >= -1e-12).all() and cal.p_cal.between(0, 1).all()


def test_ridge_matches_the_normal_equations(rows):
    m = MO.ridge_stack(rows, ["a", "b"], "y", alpha=1.0).stages[-1]
    pdf = rows.toPandas()
    x = pdf[["a", "b"]] - pdf[["a", "b"]].mean()
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (pdf.y - pdf.y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_sweeps_and_curves_are_whole(spark, monkeypatch):
    """Every quantile, column and feature count has its row."""
    monkeypatch.setattr(MO, "TREE", {**MO.TREE, "maxIter": 1, "maxDepth": 1})
    sweep = modelling.m23(spark, SF).toPandas()
    assert {0.8, 0.9, 0.92, 0.95, 0.97, 0.99} <= set(sweep["quantile"])
    assert np.allclose(sweep.tail_ratio, 1 - sweep["quantile"], atol=0.01)
    groups = {r.feature_group for r in modelling.g12(spark, SF).collect()}
    assert set(modelling.COLS) <= groups
    curve = modelling.g20(spark, SF).toPandas()
    assert curve[curve.cutoff.isna()].n_features.tolist() == list(range(1, len(modelling.COLS) + 1))
    assert curve.cutoff.dropna().tolist() == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]


def test_hyper_grid_is_whole(spark, monkeypatch):
    """Every setting has its row; stand-ins for the fits keep this short."""
    fits = []
    monkeypatch.setattr(MO, "fit_regressor", lambda df, cols, **kw: fits.append(tuple(cols)))
    monkeypatch.setattr(MO, "predict", lambda model, df, cols, name: df.withColumn(name, F.col("y") * len(cols)))
    monkeypatch.setattr(modelling, "fit_quantiles", lambda df, spec: {n: [1.0] * len(p) for n, (_, p) in spec.items()})
    grid = modelling.m21(spark, SF).toPandas()
    axes = ["tail_weight", "tail_pct", "feature_count", "interactions"]
    assert len(grid) == len(grid[axes].drop_duplicates()) == 4 * 3 * 3 * 4 and grid.notna().all().all()
    assert {c for cols in fits for c in cols} >= {*modelling.COLS, "inter_n_lines_x_qty_sum", "ratio_n_lines_to_qty_sum"}


def test_correlated_groups_are_found(rows):
    near = rows.withColumn("a2", F.col("a") * 2 + F.col("b") * 0.01)
    assert modelling.correlated_groups(near, ["a", "b", "a2", "shifted"]) == {"a+a2": ["a", "a2"]}


def test_folds_are_those_of_the_operators(spark, monkeypatch):
    """No query asks for fewer folds than an adversarial AUC takes, and gains and signs come from all folds."""
    asked, fits = [], []
    monkeypatch.setattr(MO, "adversarial_auc", lambda a, b, cols, folds=3: asked.append(folds) or (0.6, dict.fromkeys(cols, 1.0)))
    for q in (modelling.m13, modelling.m32, modelling.d24, modelling.r24):
        assert q(spark, SF).count() > 0
    assert len(asked) == 3 + 3 + 4 + 2 and set(asked) == {3}
    monkeypatch.setattr(MO, "fit_regressor", lambda df, cols: fits.append(df.count()))
    monkeypatch.setattr(MO, "importances", lambda m, cols: dict.fromkeys(cols, float(len(fits))))
    got = modelling.g11(spark, SF).toPandas()
    assert len(fits) == modelling.FOLDS and set(got.feature) == set(modelling.COLS)
    assert np.allclose(got.mean_gain, 3.0) and np.allclose(got.gain_cv, np.sqrt(2.0) / 3.0) and got.sign_stability.between(0, 1).all()
