"""The ways large inputs take, forced on small ones and compared with brute force or with the short way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import drift, embedding as EM, neighbours as NB, panel as P, ranks
from panelforge.operators.prefix import prefix_scan, row_positions
from panelforge.operators.quantiles import fit_quantiles, grouped_quantiles
from panelforge.plans import latent
from panelforge.sources import panels as S

PANEL = P.Panel("sid", ("t",))


def panel_frame(spark, n=600, seed=3):
    """A third and more of the rows in one sequence; some NULLs; ties."""
    g = np.random.default_rng(seed)
    sid = np.where(g.random(n) < 0.6, 0, g.integers(1, 12, n))
    v = np.round(g.normal(50, 20, n), 1)
    v[g.random(n) < 0.12] = np.nan
    pdf = pd.DataFrame({"sid": sid, "t": np.arange(n), "v": v})
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v"))), pdf


def test_prefix_scan_over_many_ranges(spark, many_ranges):
    df, pdf = panel_frame(spark)
    df = df.withColumn("x", F.coalesce("v", F.lit(0.0)))
    got = prefix_scan(df, ["sid"], ["t"], sums=["x"], maxes=["x"], before=["x"]).toPandas().sort_values(["sid", "t"])
    x = pdf.assign(x=pdf.v.fillna(0.0)).sort_values(["sid", "t"])
    g = x.groupby("sid").x
    assert np.allclose(got.cum_x, g.cumsum())
    assert np.allclose(got.runmax_x, g.cummax())
    assert np.allclose(got.before_x.fillna(-1), g.cummax().groupby(x.sid).shift(1).fillna(-1))


def test_positions_ignore_partitioning(spark, many_ranges):
    df, pdf = panel_frame(spark)
    a = row_positions(df, ["sid"], ["t"]).toPandas().sort_values("t").pos.tolist()
    b = row_positions(df.repartition(5), ["sid"], ["t"]).toPandas().sort_values("t").pos.tolist()
    assert a == b == pdf.groupby("sid").cumcount().tolist()


def features(df, **limits):
    def local(d, w):
        d = d.withColumn("rm5", F.avg("v").over(P.back(w, 5))).withColumn("lag1", F.lag("v").over(w))
        return d.withColumn("slope", F.col("rm5") - F.lag("rm5", 4).over(w))

    expanding = {
        "e_mean": P.Expanding("mean", "v", True), "e_std": P.Expanding("std", "v"), "e_max": P.Expanding("max", "v"),
        "e_sum": P.Expanding("sum", "v"), "e_med": P.Expanding("median", "v", True), "e_med_now": P.Expanding("median", "v"),
    }
    out = P.sequence_features(df, PANEL, local, 8, expanding, **limits)
    cols = ["sid", "t", "timestep_index", "rm5", "lag1", "slope", *expanding]
    return out.select(cols).toPandas().sort_values("t").reset_index(drop=True)


def test_hot_sequence_equals_plain_windows(spark, many_ranges):
    df, _ = panel_frame(spark)
    plain, hot = features(df), features(df, hot_rows=50, segment_rows=20)
    pd.testing.assert_frame_equal(plain.astype(float), hot.astype(float), check_exact=False, atol=1e-8)


def test_too_many_hot_sequences_take_the_segmented_way(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(P, "MAX_HOT_IDS", 2)
    df, _ = panel_frame(spark)
    pd.testing.assert_frame_equal(features(df).astype(float), features(df, hot_rows=3, segment_rows=15).astype(float), check_exact=False, atol=1e-8)


@pytest.mark.parametrize("kind", ["continuous", "ties"])
def test_bracketed_quantiles(spark, many_ranges, kind):
    g = np.random.default_rng(5)
    v = g.normal(size=5000) if kind == "continuous" else np.where(g.random(5000) < 0.4, 7.0, g.integers(0, 20, 5000)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    ps = [0.0, 0.01, 0.2, 0.5, 0.9, 0.999, 1.0]
    got = fit_quantiles(df, {"v": (F.col("v"), ps)}, buffer_rows=0)["v"]
    assert np.allclose(got, np.quantile(v, ps))


def test_quantiles_survive_a_bad_sketch(spark, many_ranges, monkeypatch):
    from panelforge.operators import quantiles as Q

    monkeypatch.setattr(Q, "_BRACKET", 0.0)
    monkeypatch.setattr(Q, "_SKETCH_ACCURACY", 5)
    v = np.random.default_rng(8).normal(size=3000)
    got = Q.fit_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})), {"v": (F.col("v"), [0.3, 0.9])}, buffer_rows=0)["v"]
    assert np.allclose(got, np.quantile(v, [0.3, 0.9]))


def test_a_row_gives_one_cell_however_many_quantiles(spark, many_ranges, monkeypatch):
    """A hundred quantiles of two columns, with ties, unknown values and brackets that meet; a value outside all brackets is only counted."""
    from panelforge.operators import quantiles as Q

    rows, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: rows.append(cut(df)) or rows[-1])
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=20_000), np.round(rng.normal(size=20_000), 1)
    df = spark.createDataFrame([(float(x), None if i % 7 == 0 else float(z)) for i, (x, z) in enumerate(zip(a, b))], "a double, b double")
    ps = [0.01 + 0.98 * i / 99 for i in range(100)]
    got = Q.fit_quantiles(df, {"a": (F.col("a"), ps), "b": (F.col("b"), ps)}, buffer_rows=0)
    known = b[np.arange(len(b)) % 7 != 0]
    assert np.allclose(got["a"], np.quantile(a, ps)) and np.allclose(got["b"], np.quantile(known, ps))
    assert len(rows) == 1 and rows[0].agg(F.sum("n")).first()[0] == len(a) + len(known) and rows[0].count() < 8_000


def test_grouped_quantiles(spark, many_ranges):
    df, pdf = panel_frame(spark)
    got = grouped_quantiles(df, ["sid"], ["v"], {"a": 0.25, "b": 0.9}).toPandas().set_index("sid")
    for sid, part in pdf.groupby("sid"):
        assert np.isclose(got.loc[sid, "a"], np.nanquantile(part.v, 0.25))
        assert np.isclose(got.loc[sid, "b"], np.nanquantile(part.v, 0.9))


def test_ranks_auc_and_pr(spark, many_ranges):
    g = np.random.default_rng(9)
    s, y = g.integers(0, 30, 400) / 30.0, g.random(400) < 0.3
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(400), "s": s, "y": y}))
    got = ranks.tie_ranks(df, [], "s").toPandas().sort_values("i")
    assert np.allclose(got.avg_rank, pd.Series(s).rank())
    pos, neg = s[y], s[~y]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert np.isclose(ranks.roc_auc(df, [], "s", F.col("y")).first().auc, brute)
    pts = ranks.pr_points(df, [], "s", F.col("y")).toPandas()
    for _, r in pts.iterrows():
        assert np.isclose(r.precision, y[s >= r.s].mean())
        assert np.isclose(r.recall, y[s >= r.s].sum() / y.sum())


def test_constant_score_has_auc_one_half(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (1.0, False)], "s double, y boolean")
    assert ranks.roc_auc(df, [], "s", F.col("y")).first().auc == 0.5


def test_drift_statistics(spark, many_ranges):
    g = np.random.default_rng(1)
    a, b = np.round(g.normal(0, 1, 700), 2), np.round(g.normal(0.3, 1.2, 500), 2)
    df = spark.createDataFrame(pd.DataFrame({"v": np.r_[a, b], "side": [True] * 700 + [False] * 500}))
    counts = drift.side_counts(df, ["v"], F.col("side"))
    grid = np.unique(np.r_[a, b])
    fa, fb = (np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b))
    assert np.isclose(drift.ks_of_cdf(drift.cdf_of_counts(counts, ["feature"])).first().ks_stat, np.abs(fa - fb).max())
    assert np.isclose(drift.wasserstein(counts).first().distance, np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)))
    lo, hi = grid.min(), grid.max()
    e, o = (np.histogram((x - lo) / (hi - lo + 1e-9), bins=10, range=(0, 1))[0] / len(x) + 1e-9 for x in (a, b))
    assert np.isclose(drift.psi(counts).first().psi, np.sum((e - o) * np.log(e / o)))


def test_same_sides_do_not_drift(spark):
    df = spark.createDataFrame([(float(i), s) for i in range(50) for s in (True, False)], "v double, side boolean")
    counts = drift.side_counts(df, ["v"], F.col("side"))
    assert drift.ks_of_cdf(drift.cdf_of_counts(counts, ["feature"])).first().ks_stat == 0
    assert drift.wasserstein(counts).first().distance == 0
    assert abs(drift.psi(counts).first().psi) < 1e-12


def test_reference_ranks_of_many_columns(spark, many_ranges):
    g = np.random.default_rng(2)
    ref, new = g.integers(0, 40, (300, 3)).astype(float), g.integers(-5, 45, (80, 3)).astype(float)
    frame = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=["a", "b", "c"]).assign(id=np.arange(len(m))))
    got = ranks.ranks_against_reference(frame(new), frame(ref), ["a", "b", "c"], "id").toPandas().sort_values("id")
    for i, c in enumerate("abc"):
        assert np.allclose(got[c], np.searchsorted(np.sort(ref[:, i]), new[:, i]) / 301)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_block_neighbours_equal_brute_force(spark, metric):
    g = np.random.default_rng(4)
    x = np.round(g.normal(size=(90, 5)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = NB.nearest(df, df, 4, metric, exclude_self=True, block_rows=16).toPandas().sort_values(["id", "pos"])
    if metric == "cosine":
        u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d = np.round(d, 9)
    np.fill_diagonal(d, np.inf)
    want = [sorted(range(90), key=lambda j: (d[i, j], j))[:4] for i in range(90)]
    assert got.groupby("id").nid.apply(list).tolist() == want


def test_neighbours_stay_within_their_group(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(60)], "id bigint, v array<double>, g int")
    got = NB.nearest(df, df, 3, "euclidean", within="g", exclude_self=True, block_rows=4).toPandas()
    assert (got.id % 3 == got.nid % 3).all() and (got.groupby("id").size() == 3).all()


def test_mean_distance(spark):
    x = np.random.default_rng(6).normal(size=(40, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).mean()
    assert np.isclose(NB.mean_distance(df, df, block_rows=8).first().mean_distance, want)


def test_neighbours_need_a_pool(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>")
    with pytest.raises(EM.PoolMissing):
        EM.fold_neighbours(df, None, 1)


def with_missing_ids(spark, n=400, seed=11):
    """A panel in which a third of the rows have no sequence id."""
    df, pdf = panel_frame(spark, n, seed)
    return df.withColumn("sid", F.when(F.col("t") % 3 == 0, None).otherwise(F.col("sid")))


@pytest.mark.parametrize("most_hot", [1_000, 2])
@pytest.mark.parametrize("hot_rows", [10_000, 100, 5])
def test_missing_ids_are_a_sequence_on_every_path(spark, many_ranges, monkeypatch, hot_rows, most_hot):
    monkeypatch.setattr(P, "MAX_HOT_IDS", most_hot)
    df = with_missing_ids(spark)
    plain, other = features(df), features(df, hot_rows=hot_rows, segment_rows=30)
    assert len(other) == 400 and other.timestep_index.notna().all()
    pd.testing.assert_frame_equal(plain.astype(float), other.astype(float), check_exact=False, atol=1e-8)


def test_missing_groups_have_sums_in_one_range_and_in_many(spark):
    df = with_missing_ids(spark).withColumn("x", F.col("t").cast("double"))
    one = prefix_scan(df.coalesce(1), ["sid"], ["t"], sums=["x"], before=["x"]).orderBy("t").toPandas()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = prefix_scan(df, ["sid"], ["t"], sums=["x"], before=["x"]).orderBy("t").toPandas()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pd.testing.assert_frame_equal(one, many)
    assert many.cum_x.notna().all()


def test_walked_medians_equal_windows(spark, monkeypatch):
    df = with_missing_ids(spark)
    plain = features(df)
    monkeypatch.setattr(P, "MEDIAN_ROWS", 3)
    pd.testing.assert_frame_equal(plain.astype(float), features(df).astype(float), check_exact=False, atol=1e-12)


def test_folds_and_samples_keep_missing_strata(spark, many_ranges):
    from panelforge.operators import splits

    df = with_missing_ids(spark)
    assert splits.stratified_folds(df, "sid", 4, "t").where("fold IS NULL").count() == 0
    taken = splits.stratified_sample(df, ["sid"], 0.5, "t").where("sid IS NULL").count()
    assert taken == df.where("sid IS NULL").count() // 2


def test_correlation_has_one_rule_at_any_width(spark, monkeypatch):
    from panelforge.operators import tables as TB

    g = np.random.default_rng(2)
    pdf = pd.DataFrame(g.normal(size=(300, 4)), columns=list("abcd")).assign(b=lambda d: d.a + d.b, e=1.0)
    pdf = pdf.mask(g.random(pdf.shape) < 0.2)
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns])
    want = pdf.corr()
    for at_once in (800, 3):
        monkeypatch.setattr(TB, "PAIRS_AT_ONCE", at_once)
        for r in TB.correlation_pairs(df, list("abcde")).collect():
            assert (r["corr"] is None) if "e" in (r.feature_a, r.feature_b) else np.isclose(r["corr"], want.loc[r.feature_a, r.feature_b])


def test_neighbours_keep_missing_groups(spark):
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=3).tolist(), None if i % 3 == 0 else str(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string")
    got = NB.nearest(df, df, 2, within="g", exclude_self=True, block_rows=4)
    assert {r.id for r in got.select("id").distinct().collect()} == set(range(30))
    kinds = {i: k for i, _, k in rows}
    assert all(kinds[r.id] == kinds[r.nid] for r in got.collect())


def test_adversarial_scores_cover_every_row(spark):
    from panelforge.operators import models as MO

    df = spark.range(3000).select("id", (F.xxhash64("id") % 100).cast("double").alias("x"))
    scored, _ = MO.adversarial_scores(df.where("id < 2000"), df.where("id >= 2000"), ["x"], folds=2, fit_rows=200, maxIter=2)
    assert scored.count() == scored.select("id").distinct().count() == 3000


def test_latent_features_cover_every_vector_and_dimension(spark):
    """Each vector against all others, itself left out, in all dimensions."""
    sf = "/root/testdata/sf0.001"
    v = S.vectors(spark, sf).toPandas().sort_values("id")
    x = np.stack(v.v.to_numpy())
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = np.round(1.0 - u @ u.T, 9) + 0.0
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :40]
    got = latent.e12(spark, sf).toPandas().sort_values("id")
    assert got.id.tolist() == v.id.tolist()
    for k in (10, 20, 40):
        z = x[near[:, :k]]
        w = np.exp(1.0 - np.maximum(np.take_along_axis(d, near[:, :k], 1), 1e-6))
        for name, want in (("embed_mean", z.mean(1)), ("embed_std", z.std(1)), ("weighted_mean", (w[:, :, None] * z).sum(1) / w.sum(1)[:, None]), ("trend_proxy", z.mean(1) - x)):
            assert np.allclose(got[[f"{name}_{k}_d{i}" for i in range(x.shape[1])]], want, atol=1e-6)
