"""Ranks against frozen rows, by lookup and in ranges, with ties, hot, unknown and infinite values; what the latents leave out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import embedding as EM, latents as LT, ranks

SPECIAL = [None, float("nan"), float("inf"), -float("inf"), -0.0, 0.0]


def frame(spark, cols):
    rows = [(i, *v) for i, v in enumerate(zip(*cols.values()))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("sent", [0, 100_000])
def test_ranks_count_the_reference_values_below(spark, monkeypatch, sent):
    monkeypatch.setattr(ranks, "SENT_VALUES", sent)
    monkeypatch.setattr(ranks, "SCAN_ROWS", 40)
    g = np.random.default_rng(8)
    ref = {"a": [*g.normal(size=400).tolist(), *SPECIAL], "b": [*g.integers(0, 9, 400).astype(float).tolist(), *SPECIAL], "none": [None] * 406}
    new = {"a": [*g.normal(size=300).tolist(), *SPECIAL], "b": [*[4.0] * 200, *g.normal(4, 3, 100).tolist(), *SPECIAL], "none": [1.0] * 306}
    got = ranks.ranks_against_reference(frame(spark, new), frame(spark, ref), list(new), "id").collect()
    got = {x.id: x for x in got}
    assert len(got) == 306
    for c in new:
        known = np.sort(np.array([v for v in ref[c] if v is not None], dtype=float))
        for i, v in enumerate(new[c]):
            assert got[i][c] is None if v is None else got[i][c] == np.searchsorted(known, v) / (len(known) + 1.0)


def test_rows_with_values_of_their_own_stay_where_they_lie(spark, monkeypatch):
    """What counts is how many values the reference has, not the rows to rank."""
    monkeypatch.setattr(ranks, "SENT_VALUES", 50)
    ref = frame(spark, {"a": [float(i % 40) for i in range(200)]})
    new = spark.range(300).select("id", (F.col("id") / 7.0).alias("a"))
    out = ranks.ranks_against_reference(new, ref, ["a"], "id")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert [x.a for x in out.orderBy("id").collect()] == [min(np.ceil(i / 7.0), 40) * 5 / 201 for i in range(300)]


def test_a_hot_value_is_several_scans(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SENT_VALUES", 0)
    monkeypatch.setattr(ranks, "SCAN_ROWS", 100)
    ref = frame(spark, {"a": [float(i) for i in range(50)]})
    new = spark.range(2_000).select("id", F.when(F.col("id") < 1_900, 7.0).otherwise(F.col("id").cast("double")).alias("a"))
    out = ranks.ranks_against_reference(new, ref, ["a"], "id")
    assert out.where("id < 1900").select(F.min("a"), F.max("a")).first()[:] == (7 / 51, 7 / 51)
    per_task = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert per_task.sum() == 2_000 and per_task.max() < 1_000


def test_transform_keeps_columns_beside_the_vectors_without_a_join(spark):
    g = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(g.normal(size=(120, 3)), columns=["a", "b", "c"]).assign(id=range(120), side=[i % 3 == 0 for i in range(120)]))
    model = LT.fit_latents(df, ["a", "b", "c"], dims=2)
    out = model.transform(df, ["side"])
    assert out.columns == ["id", "side", "v"] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = model.transform(df).toPandas().sort_values("id")
    got = out.toPandas().sort_values("id")
    assert got.side.tolist() == [i % 3 == 0 for i in range(120)] and np.allclose(np.stack(got.v), np.stack(want.v))


def test_the_audit_leaves_out_equal_ids_in_any_tile(spark, monkeypatch):
    """All rows are drawn here, so every row meets itself once, whichever tile it is in."""
    monkeypatch.setattr(LT, "AUDIT_TILE", 7)
    x = np.random.default_rng(6).normal(3, 1, size=(90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    got = LT.audit(df, 4)
    assert np.isclose(got["mean_cosine"], np.abs(u @ u.T)[~np.eye(90, dtype=bool)].mean()) and np.isclose(got["mean_variance"], x.var(0).mean())


def test_views_are_formed_where_the_rows_lie(spark):
    """Neither the fit's views nor new rows with other values are shuffled or joined for their ranks."""
    g = np.random.default_rng(9)
    df = spark.createDataFrame(pd.DataFrame(g.normal(size=(150, 3)), columns=["a", "b", "c"]).assign(id=range(150)))
    model = EM.fit_latent(df.where("id < 100"), ["a", "b", "c"], dims=2)
    out = model.transform(df.where("id >= 100"))
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and out.count() == 50
