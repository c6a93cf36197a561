"""Pruning fitted on training rows: each step by plain pandas, and decisions that other rows cannot change."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import selection as SE
from panelforge.operators.pruning import fit_pruning

COLS = ["x", "x2", "z", "w", "gaps", "flat"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=400), rng.normal(size=400) * 3
    gaps = np.where(rng.random(400) < 0.9, None, 1.0)
    return pd.DataFrame({"x": x, "x2": 2 * x + rng.normal(size=400) * 0.01, "z": z, "w": z + rng.normal(size=400) * 0.01, "gaps": gaps.astype(float), "flat": 1.0})


def side(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), ", ".join(f"{c} double" for c in rows.columns))


def test_each_step_works_on_what_the_one_before_left(spark, rows):
    fit = fit_pruning(side(spark, rows), COLS, protected=["w"])
    m = fit.manifest
    # Of x and x2 the larger variance stays; w is protected, so z goes.
    assert (m.drop_nan, sorted(m.drop_corr), m.drop_var) == (["gaps"], ["x", "z"], ["flat"])
    records = {r.feature: r for r in fit.records.collect()}
    assert {f: r.reason for f, r in records.items()} == {"gaps": "nan_drop", "x": "corr_drop", "z": "corr_drop", "flat": "variance_drop"}
    assert records["gaps"].stat_value == pytest.approx(rows["gaps"].isna().mean())
    corr = rows[["x", "x2", "z", "w"]].corr().abs()
    assert records["x"].stat_value == pytest.approx(corr.loc["x", "x2"]) and records["z"].stat_value == pytest.approx(corr.loc["z", "w"])
    distance = 1 - rows[["x", "x2", "z", "w", "flat"]].corr().abs().fillna(0).to_numpy()
    assert m.corr_threshold == pytest.approx(np.clip(np.percentile(distance[np.triu_indices(5, 1)], 25), 0.02, 0.2))
    assert m.var_threshold == pytest.approx(np.percentile(rows[["x2", "w", "flat"]].var(), 1))
    clusters = {r.feature: (r.cluster, r.kept) for r in fit.representatives.collect()}
    assert clusters["x"][0] == clusters["x2"][0] != clusters["z"][0] == clusters["w"][0] and "gaps" not in clusters


def test_importance_chooses_the_representative_from_the_columns_left(spark, rows):
    seen = []

    def importance(filled, cols):
        seen.append((cols, filled.where(" OR ".join(f"{c} IS NULL" for c in cols)).count()))
        return {"x": 2.0, "x2": 1.0}

    fit = fit_pruning(side(spark, rows), COLS, importance=importance)
    assert "x2" in fit.manifest.drop_corr and "x" not in fit.manifest.drop_corr
    assert seen == [([c for c in COLS if c != "gaps"], 0)]


def test_manifest_is_applied_to_other_rows_unchanged(spark, rows):
    fit = fit_pruning(side(spark, rows), COLS, protected=["w"])
    other = pd.DataFrame({c: np.arange(10.0) for c in COLS})
    assert fit.manifest.apply(side(spark, other)).columns == ["x2", "w"]
    with pytest.raises(SE.SchemaMismatch):
        SE.sync_schema(side(spark, other).drop("x2"), COLS, [], fit.manifest.dropped())


def test_rows_without_values_drop_nothing_that_is_known(spark, rows):
    fit = fit_pruning(side(spark, rows).limit(0), COLS)
    assert fit.manifest.dropped() == set() and fit.records.count() == 0
