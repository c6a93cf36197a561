"""Hand-checked answers on small panels, causality, fitted state and contracts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import exprs as X
from panelforge.operators import features as FE, layout as L, panel as P, policies as PO, selection as SE, splits, tables as TB
from panelforge.sources import files as IO

PANEL = P.Panel("sid", ("t",))


def frame(spark, rows, schema="sid int, t int, v double"):
    return spark.createDataFrame(rows, schema)


def run(df, kind="sensor", mean=None):
    return P.time_series_features(df, PANEL, {"v": kind}, {} if mean is None else {"v": mean}).toPandas().sort_values(["sid", "t"])


def test_windows_never_cross_a_sequence_boundary(spark):
    rows = [(1, t, 1.0 + t) for t in range(8)] + [(2, t, 1000.0 + t) for t in range(8)]
    out = run(frame(spark, rows))
    second = out[out.sid == 2]
    assert second.v_rolling_mean_5.iloc[0] == 1000.0
    assert (second.v_slope_5.iloc[:4] == 0).all() and np.isclose(second.v_slope_5.iloc[4], (1002.0 - 1000.0) / 5)
    assert second.v_diff_1.iloc[0] == 1000.0 and second.timestep_index.tolist() == list(range(8))


@pytest.mark.parametrize(
    "kind,mean,first,third",
    [("count", None, 0.0 - 0.0, 4.0 - 0.0), ("sensor", 9.0, 9.0 - 9.0, 4.0 - 2.0), ("ratio", None, 0.0 - 0.0, 4.0 - 2.0)],
)
def test_missing_values_are_filled_by_kind(spark, kind, mean, first, third):
    # NULL at the start and in the middle
    rows = [(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0)]
    out = run(frame(spark, rows), kind, mean)
    assert out.v_diff_1.iloc[0] == first
    assert out.v_diff_1.iloc[3] == third


def test_all_null_sequence_and_single_row(spark):
    out = run(frame(spark, [(1, 0, None), (1, 1, None), (2, 0, 5.0)]))
    assert out.v_rolling_std_3.tolist() == [0.0, 0.0, 0.0]
    assert out.v_rolling_mean_3.tolist() == [0.0, 0.0, 5.0]


def test_relative_position_near_zero(spark):
    out = run(frame(spark, [(1, 0, 0.0), (1, 1, 1e-9), (1, 2, 3.0)]))
    assert out.v_rel_to_mean_5.iloc[0] == 0.0 and out.v_rel_to_mean_5.iloc[1] == 0.0


def test_features_are_causal(spark):
    g = np.random.default_rng(0)
    rows = [(s, t, float(v)) for s in (1, 2) for t, v in enumerate(g.normal(size=12))]
    changed = [(s, t, v if t <= 6 else v * 100) for s, t, v in rows]
    for kind in ("sensor", "ratio", "count"):
        a, b = run(frame(spark, rows), kind, 0.0), run(frame(spark, changed), kind, 0.0)
        pd.testing.assert_frame_equal(a[a.t <= 6].reset_index(drop=True), b[b.t <= 6].reset_index(drop=True))


def test_cleaning(spark):
    df = frame(spark, [(1, 0, float("nan")), (1, 1, float("inf")), (1, 2, float("-inf")), (1, 3, 2.0)])
    assert [r.c for r in df.orderBy("t").select(X.clean(F.col("v")).alias("c")).collect()] == [None, None, None, 2.0]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.0, 1.5, 2.0, 3.0, 9.0, None)], "v double")
    got = [r.b for r in df.select(X.right_closed_bin(F.col("v"), [0, 1, 2, 2, 3]).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 0, 0]


def test_winsor_state_and_transform(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    s = FE.fit_winsor(train, ["v"])
    assert (s["v"].low, s["v"].high, s["v"].mean) == (1.0, 99.0, 50.0)
    other = spark.createDataFrame([(-50.0,), (float("nan"),), (float("inf"),), (None,), (7.0,)], "v double")
    assert [r.v for r in FE.apply_winsor(other, s).collect()] == [1.0, 50.0, 99.0, 50.0, 7.0]


def test_fitting_ignores_other_rows(spark):
    train = spark.createDataFrame([(float(i % 17),) for i in range(200)], "v double")
    again = train.union(spark.createDataFrame([(1e9,)], "v double")).where("v < 1e8")
    assert FE.fit_winsor(train, ["v"]) == FE.fit_winsor(again, ["v"])
    assert FE.fit_bin_edges(train, ["v"]) == FE.fit_bin_edges(again, ["v"])


def test_layout_fallback_order(spark):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 10.0)], "layout string, ltype string, v double")
    rows = spark.createDataFrame([("a", "x", 0.0), ("c", "y", 0.0), ("d", "z", 0.0)], "layout string, ltype string, v double")
    out = {r.layout: (r.v_layout_mean, r.v_layout_std) for r in L.apply_layout_stats(rows, L.fit_layout_stats(train, ["v"])).collect()}
    sd = float(np.std([1.0, 3.0, 10.0], ddof=1))
    assert out["a"] == (2.0, pytest.approx(np.sqrt(2.0)))
    assert out["c"] == (10.0, pytest.approx(sd))
    assert out["d"] == (pytest.approx(14 / 3), pytest.approx(sd))


def test_gate_and_damping(spark):
    df = spark.createDataFrame([(0.9, 10.0, 9.0), (0.5, 30.0, 10.0), (0.2, 30.0, 10.0), (0.1, 90.0, 10.0)], "p double, t double, nt double")
    out = PO.assemble(df).collect()
    sig = lambda p: 1 / (1 + np.exp(-8 * (p - 0.55)))
    assert out[0].weight == pytest.approx(sig(0.9))
    assert out[1].weight == pytest.approx(sig(0.5))
    assert out[2].weight == pytest.approx(0.2**1.5)
    danger, distrust = min((8 - 3) / 3, 2), (0.7 - 0.1) / 0.7
    assert out[3].weight == pytest.approx(0.1**1.5 * max(1 - danger * distrust * 0.5, 0.5), rel=1e-5)


def test_chunk_sizes_follow_the_longer_first_rule(spark):
    for n, k in ((23, 7), (7, 7), (5, 7), (100, 6)):
        got = [r.c for r in spark.range(n).select(splits.chunk_of(F.col("id"), F.lit(n), k).alias("c")).collect()]
        want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
        assert got == want


def test_leak_check_raises(spark):
    good = spark.createDataFrame([(i // 5, i) for i in range(70)], "sid int, id int")
    splits.assert_no_leak(splits.time_aware_folds(good))
    bad = spark.createDataFrame([(i % 14, i) for i in range(70)], "sid int, id int")
    with pytest.raises(AssertionError):
        splits.assert_no_leak(splits.time_aware_folds(bad))


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(splits.hash_sample(df, 50, "id")) == ids(splits.hash_sample(df.repartition(7), 50, "id"))
    share = splits.stratified_sample(df, ["c"], 0.4, "id").groupBy("c").count().collect()
    assert {r["count"] for r in share} == {133}
    folds = splits.stratified_folds(df, "c", 4, "id").groupBy("c", "fold").count().toPandas()
    assert folds["count"].min() >= 83 and folds["count"].max() <= 84


def test_kinds(spark):
    g = np.random.default_rng(0)
    pdf = pd.DataFrame({"n": g.integers(0, 9, 500).astype(float), "r": g.random(500), "s": g.normal(40, 9, 500)})
    assert TB.fit_kinds(spark.createDataFrame(pdf), ["n", "r", "s"]) == {"n": "count", "r": "ratio", "s": "sensor"}


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.00000001, "a"), (1.0, "a"), (2.0, "b")], "v double, s string")
    r = TB.duplicate_counts(df).first()
    assert (r.duplicates, r.near_duplicates, r.risk_status) == (1, 2, "HIGH")


def test_fingerprint_ignores_row_order(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    assert TB.fingerprint(a).first() == TB.fingerprint(a.orderBy(F.desc("id"))).first()
    assert TB.fingerprint(a).first() != TB.fingerprint(a.withColumn("x", F.col("x") + 1)).first()


def test_linkage(spark):
    corr = np.array([[1, 0.95, 0.1, 0.0], [0.95, 1, 0.2, 0.0], [0.1, 0.2, 1, 0.9], [0.0, 0.0, 0.9, 1]])
    assert SE.linkage_clusters(1 - corr, 0.2) == [0, 0, 1, 1]
    assert SE.linkage_clusters(1 - corr, 0.01) == [0, 1, 2, 3]
    assert SE.linkage_clusters(1 - corr, 1.0, "complete") == [0, 0, 0, 0]


def test_representatives_keep_protected(spark):
    c = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "feature string, cluster int")
    imp = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0), ("d", 3.0)], "feature string, importance double")
    kept = {r.feature for r in SE.representatives(c, imp, ["a"]).where("kept").collect()}
    assert kept == {"a", "d"}


def test_gap_threshold(spark):
    r = spark.createDataFrame([(f"f{i}", 0.10 + 0.001 * i) for i in range(20)] + [("g", 0.45), ("h", 0.46)], "feature string, ratio double")
    assert SE.gap_threshold(r).first().threshold == pytest.approx(0.45)
    flat = spark.createDataFrame([(f"f{i}", 0.1) for i in range(5)], "feature string, ratio double")
    assert SE.gap_threshold(flat).first().threshold == 0.5


def test_schema_sync(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    assert SE.sync_schema(df, ["a"], ["id"]).columns == ["id", "a"]
    with pytest.raises(SE.SchemaMismatch):
        SE.sync_schema(df, ["a", "z"], ["id"])
    with pytest.raises(SE.SchemaMismatch):
        SE.sync_schema(df, ["a"], ["id"], allow_extra=False)


def test_submission_contract(spark):
    sample = spark.range(5)
    good = IO.build_submission(spark.createDataFrame([(i, i + 0.0005) for i in range(5)], "id bigint, pred double"))
    assert [r.pred for r in good.orderBy("id").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert set(IO.submission_errors(good, sample).first()) == {0, 5}
    a, b = sample.withColumn("pos", F.col("id")), good.withColumn("pos", 4 - F.col("id"))
    assert spark.range(1).select(IO.order_mismatches(b, a)).first()[0] == 4


def test_positions_over_files_and_blocks(spark, tmp_path):
    ids = [(i * 37) % 101 for i in range(101)]
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("id\n" + "".join(f"{i}\n" for i in ids[part * 40 : part * 40 + 40]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # a file is many blocks
    try:
        got = IO.with_positions(IO.read_csv(spark, str(tmp_path), "id long")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.id, r.pos) for r in got] == [(i, n) for n, i in enumerate(ids)]


def test_stage_contract(spark):
    df = spark.range(3)
    assert IO.require(df, ["id"], "x") is df
    with pytest.raises(IO.StageInputMissing):
        IO.require(df, ["nope"], "x")
    with pytest.raises(IO.StageInputMissing):
        IO.require(df.where("id > 5"), ["id"], "x")


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(X.corr("a", "b")).first()[0] is None
