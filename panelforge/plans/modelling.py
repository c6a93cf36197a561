"""Model queries (rows-only: fitted values differ between engines; properties are tested instead)."""

from __future__ import annotations

import random
from functools import reduce
from itertools import accumulate, combinations, product
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import exprs as X
from panelforge.operators import boosting as B, drift, features as FE, fold_state as FS, metrics as M, models as MO, policies as PO, proxies as PX, ranks, splits, tables
from panelforge.operators.quantiles import fit_quantiles
from panelforge.operators.side_by_side import side_by_side
from panelforge.plans.registry import query
from panelforge.session import cut_lineage, ensure_checkpoint_dir, stored
from panelforge.sources import panels as S

COLS = list(S.MODEL_FEATURES)
FOLDS = 5


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows, materialised once because several fits read them."""
    return cut_lineage(S.model_panel(spark, sf_dir))


def chunked(rows: DataFrame, n_folds: int = FOLDS) -> DataFrame:
    train = rows.where("is_train")
    out = splits.time_aware_folds(train, n_folds, "sid", "day")
    splits.assert_no_leak(out, n_folds, "day")
    return cut_lineage(out)


def listing(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fold- or setting-sized results as a frame."""
    return spark.createDataFrame(rows, schema)


def tail_label(rows: DataFrame, p: float = 0.9) -> DataFrame:
    return rows.withColumn("tail", F.col("y") >= fit_quantiles(rows, {"y": (F.col("y"), [p])})["y"][0])


@query("m1_raw_baseline_oof")
def m1(spark, sf_dir):
    rows = chunked(frame(spark, sf_dir))
    pairs = [MO.fold_frames(rows, f) for f in range(FOLDS)]
    fitted = side_by_side([lambda t=train: MO.fit_regressor(t, COLS) for train, _ in pairs])
    parts = [MO.predict(m, val, COLS, "oof").select("id", F.lit(f).alias("fold"), "y", "oof") for f, (m, (_, val)) in enumerate(zip(fitted, pairs))]
    return reduce(DataFrame.unionByName, parts)


@query("m2_tail_classifier")
def m2(spark, sf_dir):
    rows = tail_label(frame(spark, sf_dir))
    train = rows.where("is_train").withColumn("w", F.when(F.col("tail"), 2.0).otherwise(1.0))
    m = MO.fit_classifier(train, COLS, "tail", weight="w")
    return MO.probability(m, rows.where("NOT is_train"), COLS, "p").select("id", "tail", "p")


@query("m3_tail_and_bulk_regressors")
def m3(spark, sf_dir):
    rows = frame(spark, sf_dir)
    m = MO.fit_two_stage(rows.where("is_train"), COLS, poison=["tax_avg"], destructive=["qty_max"])
    return m.score(rows.where("NOT is_train")).select("id", "y", "p", "t", "nt", "blended")


@query("m6_two_pass_training")
def m6(spark, sf_dir):
    """Feature state, drift filters, weights and the two-stage model of each fold; out-of-fold rows."""
    rows = frame(spark, sf_dir)
    return FS.train_run(chunked(rows), rows.where("NOT is_train"), COLS, FOLDS, poison=["tax_avg"], destructive=["qty_max"])[1]


@query("m12_fold_inference_from_state")
def m12(spark, sf_dir):
    """Train and store a run, then score new rows from its folder alone: features, models, calibration, mean over folds."""
    rows = frame(spark, sf_dir)
    test = rows.where("NOT is_train")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/state-{uuid4().hex}"
    FS.train_run(chunked(rows), test, COLS, FOLDS, poison=["tax_avg"], destructive=["qty_max"])[0].save(folder)
    return FS.Run.load(spark, folder).score(test)


@query("m7_adversarial_auc")
def m7(spark, sf_dir):
    rows = frame(spark, sf_dir)
    auc, imp = MO.adversarial_auc(rows.where("is_train"), rows.where("NOT is_train"), COLS)
    out = listing(spark, [(c, auc, v) for c, v in imp.items()], "feature string, adv_auc double, importance double")
    return out.withColumn("status", MO.shift_status(F.col("adv_auc")))


@query("m7_fold_proxy_audit")
def m7_parts(spark, sf_dir):
    """Every fold's validation rows, the test-like holdout, the rest and the whole training side, each told apart from the test side."""
    rows = frame(spark, sf_dir)
    train, folds = rows.where("is_train"), chunked(rows)
    proxy = cut_lineage(x9(spark, sf_dir).where("is_proxy").select("sid"))
    parts = {f"fold_{f}": folds.where(F.col("chunk") == f + 2) for f in range(FOLDS)}
    parts |= {"proxy": cut_lineage(train.join(proxy, "sid", "left_semi")), "not_proxy": cut_lineage(train.join(proxy, "sid", "left_anti")), "train": train}
    return PX.adversarial_table(spark, parts, rows.where("NOT is_train"), COLS)


@query("m10_ridge_stack")
def m10(spark, sf_dir):
    pp = S.pred_panel(spark, sf_dir).select("id", "y", "t", "nt", "p")
    m = MO.ridge_stack(pp, ["t", "nt", "p"], "y")
    p99 = fit_quantiles(pp, {"y": (F.col("y"), [0.99])})["y"][0]
    return m.transform(pp).select("id", "y", X.clip(F.col("prediction"), 0.0, 1.5 * p99).alias("stacked"))


@query("m13_inter_fold_auc_matrix")
def m13(spark, sf_dir):
    rows = cut_lineage(frame(spark, sf_dir).withColumn("part", splits.hash_fold(3, F.col("sid"))))
    out = []
    for i in range(3):
        for j in range(i + 1, 3):
            auc, _ = MO.adversarial_auc(rows.where(F.col("part") == i), rows.where(F.col("part") == j), COLS)
            out.append((i, j, auc))
    return listing(spark, out, "fold_a int, fold_b int, auc double")


@query("j9_fold_pairs", "SELECT a.f AS fold_a, b.f AS fold_b, a.n AS n_a, b.n AS n_b FROM (SELECT CAST(o_orderkey % 5 AS INTEGER) AS f, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT CAST(o_orderkey % 5 AS INTEGER) AS f, count(*) AS n FROM orders GROUP BY 1) b ON a.f < b.f")
def j9(spark, sf_dir):
    n = S.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).cast("int").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col("f").alias("fold_a"), F.col("n").alias("n_a")), n.select(F.col("f").alias("fold_b"), F.col("n").alias("n_b"))
    return a.join(b, F.col("fold_a") < F.col("fold_b"))  # one row per fold on either side


@query("m14_pseudo_test_rows")
def m14(spark, sf_dir):
    rows = S.model_panel(spark, sf_dir)
    harder = splits.unit_hash(F.col("id"), seed=42) < 0.2
    normal = list(MO.noise_columns(len(COLS)).values())
    noise = {c: (F.col(c) + normal[i] * 0.1) * F.when(harder, 1.2).otherwise(1.0) for i, c in enumerate(COLS)}
    return rows.withColumns(noise).select("id", "y", *COLS)


@query("m15_isotonic_calibration")
def m15(spark, sf_dir):
    pp = tail_label(S.pred_panel(spark, sf_dir)).select("id", "p", "tail", "t", "nt", "y")
    cal = MO.isotonic(pp, "p", "tail").transform(pp)
    gated = F.when(F.col("p_cal") < 0.05, F.col("nt")).otherwise(F.col("nt") + F.col("p") * F.col("p") * (F.col("t") - F.col("nt")))
    return cal.select("id", "p", "p_cal", X.blend(F.col("p_cal"), F.col("t"), F.col("nt")).alias("blended"), gated.alias("gated"))


@query("m19_gain_predictor")
def m19(spark, sf_dir):
    pp = S.pred_panel(spark, sf_dir)
    gain = F.abs(F.col("y") - F.col("nt")) - F.abs(F.col("y") - F.col("t"))
    rows = cut_lineage(pp.select("id", "p", "t", "nt", "gap", "y", (gain > 0).alias("better")))
    cols = ["p", "t", "nt", "gap"]
    fold = splits.hash_fold(2, F.col("id"))
    m = MO.fit_classifier(rows.where(fold == 0), cols, "better")
    val = MO.probability(m, rows.where(fold == 1), cols, "gain_p")
    return val.select("id", "y", "gain_p", F.when(F.col("gain_p") > 0.5, F.col("t")).otherwise(F.col("nt")).alias("chosen"))


TAIL_WEIGHTS, TAIL_PCTS, FEATURE_COUNTS = (1.0, 1.5, 2.0, 3.0), (90, 95, 97), (4, 8, 16)
#: Predictions that stand side by side in one frame.
SCORED_TOGETHER = 10
#: Prefixes of the pair columns that a setting may use.
INTERACTIONS = {"none": (), "base_only": ("inter_",), "ratio_only": ("ratio_",), "full": ("inter_", "ratio_", "diff_", "logprod_")}


def pair_columns(cols) -> dict:
    """Product, ratio, difference and log product of each pair of columns."""
    out = {}
    for x, z in combinations(cols, 2):
        a, b = F.col(x), F.col(z)
        out |= {f"inter_{x}_x_{z}": a * b, f"ratio_{x}_to_{z}": a / (b + 1e-9), f"diff_{x}_{z}": a - b, f"logprod_{x}_{z}": F.log1p(a * b)}
    return out


def grid_columns(extra, kind: str, n: int) -> list[str]:
    """All columns of a kind of interactions, or the first three and a seeded choice of the others where there are more than n."""
    cols = [*COLS, *(c for c in extra if c.startswith(INTERACTIONS[kind]))]
    return cols if n >= len(cols) else [*cols[:3], *random.Random(42).sample(cols[3:], n - 3)]


@query("m21_hyper_grid")
def m21(spark, sf_dir):
    """Each tail weight, tail share, feature count and kind of interactions; equal columns and weights are fitted once."""
    extra = pair_columns(COLS[:5])
    rows = stored(S.model_panel(spark, sf_dir))
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    cuts = dict(zip(TAIL_PCTS, fit_quantiles(train, {"y": (F.col("y"), [p / 100 for p in TAIL_PCTS])})["y"]))
    sd, top = test.agg(F.stddev_pop("y").alias("s")).first().s, fit_quantiles(test, {"y": (F.col("y"), [0.99])})["y"][0]
    settings = [(w, pct, n, kind, grid_columns(extra, kind, n)) for w, pct, n, kind in product(TAIL_WEIGHTS, TAIL_PCTS, FEATURE_COUNTS, INTERACTIONS)]
    keys = {(w, pct if w != 1.0 else None, tuple(cols)): pct for w, pct, _, _, cols in settings}
    weights = {f"w{TAIL_WEIGHTS.index(w)}_{pct}": F.when(F.col("y") > cuts[pct], w).otherwise(1.0) for w, pct in product(TAIL_WEIGHTS, TAIL_PCTS) if w != 1.0}
    specs = [B.Spec(cols, "target", f"w{TAIL_WEIGHTS.index(w)}_{pct}" if w != 1.0 else None) for (w, _, cols), pct in keys.items()]
    models = B.fit_all(train.withColumns(extra), specs, {"target": F.log1p("y")} | weights)
    pred = stored(B.values_of_all(test.withColumns(extra), models, {"y": F.col("y")}))

    def measured(names):
        """All measures of some models from one pass and one set of quantiles."""
        p99 = fit_quantiles(pred, {n: (F.col(n), [0.99]) for n in names})
        miss = {n: F.abs(F.col("y") - F.col(n)) for n in names}
        m = pred.agg(*[x for n in names for x in (F.stddev_pop(n).alias(f"s_{n}"), F.avg(miss[n]).alias(f"e_{n}"), F.avg(F.when(F.col("y") >= top, miss[n])).alias(f"t_{n}"))]).first()
        return [(m[f"s_{n}"] / (sd + 1e-9), p99[n][0] / (top + 1e-9), m[f"e_{n}"], m[f"t_{n}"]) for n in names]

    names = [f"p{i}" for i in range(len(models))]
    measures = [x for part in side_by_side([lambda k=k: measured(names[k : k + SCORED_TOGETHER]) for k in range(0, len(names), SCORED_TOGETHER)]) for x in part]
    done = dict(zip(keys, measures))
    out = [(w, pct, n, kind, len(cols), *done[w, pct if w != 1.0 else None, tuple(cols)]) for w, pct, n, kind, cols in settings]
    return listing(spark, out, "tail_weight double, tail_pct int, feature_count int, interactions string, n_features int, std_ratio double, p99_ratio double, mae double, q99_mae double")


def classifier_row(train, val, cols, **kw):
    """(precision at p > 0.7, recall at p > 0.5, AUC) of a tail classifier."""
    s = MO.probability(MO.fit_classifier(train, cols, "tail", **kw), val, cols, "p")
    p, t = F.col("p"), F.col("tail")
    m = s.agg(F.coalesce(F.try_divide(F.count_if((p > 0.7) & t), F.count_if(p > 0.7)), F.lit(0.0)).alias("a"), F.coalesce(F.try_divide(F.count_if((p > 0.5) & t), F.count_if(t)), F.lit(0.0)).alias("b")).first()
    return m.a, m.b, ranks.roc_auc(s, [], "p", t).first().auc, s


@query("m23_label_threshold_sweep")
def m23(spark, sf_dir):
    """A classifier for each quantile of the target; all are fitted and measured in shared passes."""
    rows, shares = stored(S.model_panel(spark, sf_dir)), (0.8, 0.9, 0.92, 0.95, 0.97, 0.99)
    cuts = fit_quantiles(rows, {"y": (F.col("y"), shares)})["y"]
    tails = {f"t{i}": (F.col("y") >= c).cast("double") for i, c in enumerate(cuts)}
    models = B.fit_all(rows.where("is_train"), [B.Spec(tuple(COLS), t, loss="logistic") for t in tails], tails)
    scored = stored(B.values_of_all(rows.where("NOT is_train"), models, tails))
    ratio = rows.agg(*[F.avg(t).alias(n) for n, t in tails.items()]).first()
    found = [F.coalesce(F.try_divide(F.count_if((F.col(f"p{i}") > x) & (F.col(t) == 1)), F.count_if(F.col(of) > y)), F.lit(0.0)).alias(f"{n}{i}") for i, t in enumerate(tails) for n, x, of, y in (("a", 0.7, f"p{i}", 0.7), ("b", 0.5, t, 0.5))]
    m = scored.agg(*found).first()
    long = scored.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("p"), (F.col(t) == 1).alias("tail")) for i, t in enumerate(tails)])))
    auc = {x.i: x.auc for x in ranks.roc_auc(long, ["i"], "p", F.col("tail")).collect()}
    out = [(p, ratio[f"t{i}"], m[f"a{i}"], m[f"b{i}"], auc[i]) for i, p in enumerate(shares)]
    return listing(spark, out, "quantile double, tail_ratio double, precision_at_07 double, recall double, auc double")


@query("m24_class_weight_sweep")
def m24(spark, sf_dir):
    rows, out = tail_label(frame(spark, sf_dir), 0.95), []
    for w in (1.0, 5.0, 0.2):
        r = rows.withColumn("w", F.when(F.col("tail"), w).otherwise(1.0))
        a, b, auc, _ = classifier_row(r.where("is_train"), r.where("NOT is_train"), COLS, weight="w")
        out.append((w, a, b, auc))
    return listing(spark, out, "class_weight double, precision_at_07 double, recall double, auc double")


@query("m25_classifier_vs_ranker")
def m25(spark, sf_dir):
    rows = tail_label(frame(spark, sf_dir))
    train, val = rows.where("is_train"), rows.where("NOT is_train")
    *_, clf = classifier_row(train, val, COLS)
    rank = MO.predict(MO.fit_regressor(train, COLS), val, COLS, "p").select("id", "tail", "p")
    both = clf.select(F.lit("classifier").alias("model"), "tail", "p").unionByName(rank.select(F.lit("ranker").alias("model"), "tail", "p"))
    return ranks.roc_auc(both, ["model"], "p", F.col("tail"))


@query("m26_tail_permutation_importance")
def m26(spark, sf_dir):
    rows = tail_label(frame(spark, sf_dir))
    m = MO.fit_regressor(rows.where("is_train"), COLS)
    tail = cut_lineage(rows.where("NOT is_train AND tail"))
    d = MO.permutation_importance(m, tail, COLS, {c: [c] for c in COLS})
    return listing(spark, list(d.items()), "feature string, delta double")


@query("m28_factor_ablation")
def m28(spark, sf_dir):
    rows, out = tail_label(frame(spark, sf_dir)), []
    base = None
    for name, cols in (("all", COLS), ("no_quantity", [c for c in COLS if not c.startswith("qty")]), ("no_rates", [c for c in COLS if not c.endswith("avg")])):
        a, b, auc, s = classifier_row(rows.where("is_train"), rows.where("NOT is_train"), cols)
        pr = M.pr_summary(s, "p", F.col("tail")).first().pr_auc
        base = base or (a, pr)
        out.append((name, a - base[0], pr - base[1], auc))
    return listing(spark, out, "variant string, delta_precision double, delta_pr_auc double, auc double")


@query("m29_layout_holdout_model")
def m29(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("hidden", splits.unit_hash(F.col("layout")) < 0.2)
    m = MO.fit_regressor(rows.where("NOT hidden"), COLS)
    val = MO.predict(m, rows.where("hidden"), COLS, "pred")
    edges = fit_quantiles(val, {"y": (F.col("y"), [i / 10 for i in range(11)])})["y"]
    return M.segment_report(val, X.right_closed_bin(F.col("y"), edges), "y", "pred").withColumnRenamed("segment", "decile")


@query("m30_two_stage_meta_gate")
def m30(spark, sf_dir):
    rows = tail_label(frame(spark, sf_dir))
    train = rows.where("is_train")
    first = MO.fit_classifier(train, COLS, "tail")
    likely = MO.probability(first, train, COLS, "p").where("p > 0.2")
    scored = MO.probability(first, rows.where("NOT is_train"), COLS, "p")
    meta = MO.forest(likely, COLS, "tail")
    return MO.probability(meta, scored, COLS, "p_meta").select("id", "tail", "p", "p_meta", (F.col("p") * F.col("p_meta")).alias("p_final"))


@query("m31_leave_one_interaction_out")
def m31(spark, sf_dir):
    rows = cut_lineage(frame(spark, sf_dir).withColumn("inter_a", F.col("qty_sum") * F.col("disc_avg")).withColumn("inter_b", F.col("n_lines") * F.col("qty_avg")))
    train, val, extra = rows.where("is_train"), rows.where("NOT is_train"), ["inter_a", "inter_b"]
    score = lambda cols: MO.mae(MO.predict(MO.fit_regressor(train, cols), val, cols, "p"), "y", "p")
    full = score(COLS + extra)
    out = [(e, score(COLS + [x for x in extra if x != e]) - full) for e in extra]
    return listing(spark, out, "feature string, delta_mae double").withColumn("verdict", F.when(F.col("delta_mae") > 0, "HELPFUL").otherwise("REDUNDANT"))


@query("m32_auc_per_feature_family")
def m32(spark, sf_dir):
    rows = frame(spark, sf_dir)
    fam = {"counts": ["n_lines", "qty_sum"], "averages": ["qty_avg", "disc_avg", "tax_avg"], "peaks": ["qty_max"]}
    out = [(n, MO.adversarial_auc(rows.where("is_train"), rows.where("NOT is_train"), c)[0]) for n, c in fam.items()]
    return listing(spark, out, "family string, auc double")


@query("d24_drift_root_cause_shares")
def d24(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("layout", F.col("layout").cast("double"))
    cols = COLS + ["layout"]
    a, b = MO.dealt(*(side.select("id", *cols) for side in (rows.where("is_train"), rows.where("NOT is_train"))))
    full, imp = MO.adversarial_auc(a, b, cols)
    top = max(imp, key=lambda c: imp[c])
    variants = {"no_top_drift": [c for c in cols if c != top], "no_layout": COLS, "layout_only": ["layout"]}
    aucs = side_by_side([lambda c=c: MO.adversarial_auc(a, b, c)[0] for c in variants.values()])
    out = [("full", full, 0.0)] + [(n, x, (full - x) / (full - 0.5 + 1e-9)) for n, x in zip(variants, aucs)]
    return listing(spark, out, "variant string, auc double, share double")


@query("m33_target_transform_comparison")
def m33(spark, sf_dir):
    rows = frame(spark, sf_dir)
    train, val = rows.where("is_train"), rows.where("NOT is_train")
    out = [(n, MO.mae(MO.predict(MO.fit_regressor(train, COLS, log=log), val, COLS, "p", log=log), "y", "p")) for n, log in (("log", True), ("raw", False))]
    two = MO.fit_two_stage(train, COLS)
    out.append(("tail_only_log", MO.mae(two.score(val), "y", "blended")))
    return listing(spark, out, "transform string, mae double")


@query("x9_test_proxy_holdout")
def x9(spark, sf_dir):
    """Sequences of the training side, scored by how test-like their profile is; the top fifth is the holdout."""
    rows = frame(spark, sf_dir)
    stats = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
    prof = rows.groupBy("sid", "is_train").agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in COLS for n, f in stats.items()])
    cols = [c for c in prof.columns if c not in ("sid", "is_train")]
    prof = cut_lineage(prof.fillna(MO.SENTINEL).withColumn("is_test", (~F.col("is_train")).cast("int")))
    m = MO.fit_classifier(prof, cols, "is_test")
    scored = MO.probability(m, prof.where("is_train"), cols, "test_similarity").select("sid", "test_similarity")
    top = splits.top_share(scored, "test_similarity", "sid", 0.2).select("sid", F.lit(True).alias("is_proxy"))
    rest = splits.scenario_chunks(rows.where("is_train").join(top, "sid", "left_anti"), FOLDS, "sid", "day").select("sid", "chunk")
    return scored.join(top, "sid", "left").join(rest, "sid", "left").withColumn("is_proxy", F.coalesce("is_proxy", F.lit(False)))


@query("r24_proxy_validity_verdict")
def r24(spark, sf_dir):
    rows = frame(spark, sf_dir)
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    last = splits.top_share(train.groupBy("sid").agg(F.max("day").alias("d")), "d", "sid", 0.2).select("sid")
    proxy = cut_lineage(train.join(last, "sid", "left_semi"))
    from panelforge.operators.sets import labelled_union

    mean_ks = lambda a: drift.ks_table(labelled_union(a.select(*COLS), test.select(*COLS)), COLS, F.col("is_test") == 0).agg(F.avg("ks_stat")).first()[0]
    k_all, k_proxy = mean_ks(train), mean_ks(proxy)
    auc_all, auc_proxy = (MO.adversarial_auc(a, test, COLS)[0] for a in (train, proxy))
    m = proxy.agg(F.avg("y").alias("m")).first().m / (train.agg(F.avg("y").alias("m")).first().m + 1e-9)
    ok = (k_proxy < 0.9 * k_all, auc_all - auc_proxy >= 0.05 and auc_proxy < 0.70, abs(1 - m) < 0.25)
    return listing(spark, [(k_all, k_proxy, auc_all, auc_proxy, *ok, "VALID" if all(ok) else "INVALID")], "ks_train double, ks_proxy double, auc_train double, auc_proxy double, ks_valid boolean, auc_valid boolean, aligned boolean, verdict string")


@query("g8_collective_drift_pruner")
def g8(spark, sf_dir):
    rows = frame(spark, sf_dir)
    kept, history, reached = MO.prune_collective_drift(rows.where("is_train"), rows.where("NOT is_train"), COLS, target_auc=0.501)
    return listing(spark, [(*h, reached, ",".join(kept)) for h in history], "iteration int, auc double, n_features int, reached boolean, kept string")


@query("g9_tail_importance_protection")
def g9(spark, sf_dir):
    rows = frame(spark, sf_dir).where("is_train")
    return listing(spark, MO.tail_protected(rows, COLS), "feature string, importance_all double, importance_tail double")


@query("g10_noise_gain_floor")
def g10(spark, sf_dir):
    noise = MO.noise_columns(10)
    rows = cut_lineage(frame(spark, sf_dir).where("is_train").withColumns(noise))
    cols = COLS + list(noise)
    imp = MO.importances(MO.fit_regressor(rows, cols), cols)
    ceiling = max(imp[c] for c in noise)
    real = sorted(imp[c] for c in COLS)
    floor = max(ceiling * 1.2, real[int(0.2 * (len(real) - 1))])
    return listing(spark, [(c, imp[c], imp[c] > floor, c in noise) for c in cols], "feature string, gain double, beats_noise boolean, is_noise boolean")


@query("g11_cross_fold_gain_and_sign")
def g11(spark, sf_dir):
    rows = stored(S.model_panel(spark, sf_dir).where("is_train").withColumn("fold", splits.hash_fold(FOLDS, F.col("id"))))
    held = {f"w{f}": (F.col("fold") != f).cast("double") for f in range(FOLDS)}
    gains = [m.importances() for m in B.fit_all(rows, [B.Spec(tuple(COLS), "target", w) for w in held], {"target": F.log1p("y")} | held)]
    one = drift.stats_long(rows, COLS, **{f"s{f}": lambda c, f=f: F.signum(X.corr(F.when(F.col("fold") != f, c), F.col("y"))) for f in range(FOLDS)})
    signs = one.select("feature", F.explode(F.array(*[f"s{f}" for f in range(FOLDS)])).alias("s"))
    mean = {c: sum(x[c] for x in gains) / FOLDS for c in COLS}
    cv = {c: (sum((x[c] - mean[c]) ** 2 for x in gains) / FOLDS) ** 0.5 / (mean[c] + 1e-9) if mean[c] > 0 else 1.0 for c in COLS}
    g = listing(spark, [(c, mean[c], cv[c]) for c in COLS], "feature string, mean_gain double, gain_cv double")
    s = signs.groupBy("feature").agg(F.abs(F.avg("s")).alias("stable"))
    stable = F.col("stable")
    return g.join(s, "feature").select("feature", "mean_gain", "gain_cv", stable.alias("sign_stability"), ((1.0 - F.least(F.col("gain_cv"), F.lit(1.0))) * 0.5 + stable * 0.5).alias("stability_factor"))


def correlated_groups(rows: DataFrame, cols, limit: float = 0.95) -> dict[str, list[str]]:
    """Each column with the others that correlate with it above the limit, where there are any; equal groups once."""
    near = {(r.feature_a, r.feature_b) for r in tables.correlation_pairs(rows, cols).where(F.col("corr") > limit).collect()}
    groups = [[c for c in cols if c == x or (c, x) in near or (x, c) in near] for x in cols]
    return {"+".join(g): g for g in groups if len(g) > 1}


@query("g12_permutation_importance")
def g12(spark, sf_dir):
    """Each column alone, and each group of correlated columns together."""
    rows = frame(spark, sf_dir)
    train = rows.where("is_train")
    m = MO.fit_regressor(train, COLS)
    val = cut_lineage(rows.where("NOT is_train"))
    d = MO.permutation_importance(m, val, COLS, {c: [c] for c in COLS} | correlated_groups(train, COLS))
    return listing(spark, list(d.items()), "feature_group string, delta double")


CUTOFFS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


@query("g20_feature_count_curve")
def g20(spark, sf_dir):
    """Every count of the most important columns, and the counts that cutoffs of the summed importance give."""
    rows, target = stored(S.model_panel(spark, sf_dir)), {"target": F.log1p("y")}
    train, val = rows.where("is_train"), rows.where("NOT is_train")
    whole = B.fit_all(train, [B.Spec(tuple(COLS), "target")], target)[0]
    imp = whole.importances()
    order = sorted(COLS, key=lambda c: (-imp[c], c))
    share = [v / (sum(imp.values()) or 1.0) for v in accumulate(imp[c] for c in order)]
    models = [*B.fit_all(train, [B.Spec(tuple(order[:k]), "target") for k in range(1, len(order))], target), whole]  # all columns are the first model
    errors = val.agg(*[F.avg(F.abs(F.col("y") - m.value())).alias(f"e{k}") for k, m in enumerate(models)]).first()
    curve = [(k, share[k - 1], errors[f"e{k - 1}"]) for k in range(1, len(order) + 1)]
    # A cutoff takes the columns within it, and the first one at least.
    chosen = [(c, *curve[max(1, sum(s <= c for s in share)) - 1]) for c in CUTOFFS]
    return listing(spark, [(None, *x) for x in curve] + chosen, "cutoff double, n_features int, importance_share double, mae double")
