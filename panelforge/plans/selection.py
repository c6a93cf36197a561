"""Feature selection and pruning queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X, names as N
from panelforge.operators import drift, features as FE, metrics as M, models as MO, pruning as PR, selection as SE, tables as TB
from panelforge.operators.quantiles import fit_quantiles
from panelforge.plans.aggregates import CORR_SQL, FOLD_TOP_SQL, corr_pairs_sql, filled
from panelforge.plans.drift_audit import BASE, IMP_SQL, KNEE_SQL, LIST, LONG_SQL, drift_with_importance, ks_sql, sensor_ks
from panelforge.plans.features import CATEGORY_SQL, NAMED, PAIRS, STATS_SQL, named_features
from panelforge.plans.registry import ORDERS_SQL, query, r, sr, with_sql
from panelforge.session import cut_lineage
from panelforge.sources import panels as S

SEN = S.SENSORS
PROTECTED = ("qty_sum", "n_lines")
NULLS_SQL = "nr AS (UNPIVOT (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS {c}" for c in NAMED) + " FROM wide) ON COLUMNS(*) INTO NAME feature VALUE ratio)"
GAP_SQL = """gj AS (SELECT *, ratio - lag(ratio) OVER (ORDER BY ratio, feature) AS jump FROM nr),
gt AS (SELECT CASE WHEN max(jump) > avg(jump) + 2 * stddev_samp(jump) AND arg_max(ratio, round(jump, 12) - ratio * 1e-13) > quantile_cont(ratio, 0.5) + 1e-6 THEN arg_max(ratio, round(jump, 12) - ratio * 1e-13) ELSE 0.5 END AS threshold,
 coalesce(max(jump) > avg(jump) + 2 * stddev_samp(jump) AND arg_max(ratio, round(jump, 12) - ratio * 1e-13) > quantile_cont(ratio, 0.5) + 1e-6, false) AS gap_found FROM gj)"""


def null_ratios(spark, sf_dir):
    return drift.stats_long(named_features(spark, sf_dir), NAMED, ratio=lambda c: F.avg(c.isNull().cast("double")))


@query("g1_adaptive_nan_threshold", with_sql(ORDERS_SQL, f"SELECT {sr('threshold')} AS threshold, gap_found, (SELECT CAST(count(*) AS BIGINT) FROM nr, gt g2 WHERE ratio > g2.threshold) AS n_dropped FROM gt", STATS_SQL, NULLS_SQL, GAP_SQL))
def g1(spark, sf_dir):
    ratios = null_ratios(spark, sf_dir)
    t = SE.gap_threshold(ratios)
    dropped = ratios.where(F.col("ratio") > t.select("threshold").scalar()).agg(F.count(F.lit(1)).alias("n")).scalar()
    return t.select(r("threshold").alias("threshold"), "gap_found").withColumn("n_dropped", dropped)


@query("w21_largest_jump", with_sql(ORDERS_SQL, f"SELECT feature, {sr('ratio')} AS ratio, {sr('jump')} AS jump, jump > (SELECT avg(jump) + 2 * stddev_samp(jump) FROM gj) AS significant FROM gj WHERE jump IS NOT NULL", STATS_SQL, NULLS_SQL, GAP_SQL))
def w21(spark, sf_dir):
    ordered = SE.everything().orderBy("ratio", "feature")  # one row per feature
    j = null_ratios(spark, sf_dir).withColumn("jump", F.col("ratio") - F.lag("ratio").over(ordered)).where("jump IS NOT NULL")
    limit = j.agg((F.avg("jump") + 2 * F.stddev_samp("jump")).alias("l")).scalar()
    return j.select("feature", r("ratio").alias("ratio"), r("jump").alias("jump"), (F.col("jump") > limit).alias("significant"))


VAR_SQL = "vr AS (UNPIVOT (SELECT " + ", ".join(f"var_samp({c}) AS {c}" for c in SEN) + " FROM op) ON COLUMNS(*) INTO NAME feature VALUE variance)"


def variances(spark, sf_dir):
    return drift.stats_long(S.order_panel(spark, sf_dir), SEN, variance=F.var_samp)


@query("g4_variance_floor", with_sql(ORDERS_SQL, f"SELECT feature, {sr('variance', 4)} AS variance, variance < t AS below_floor FROM vr, (SELECT greatest(1.1920928955078125e-07, quantile_cont(variance, 0.01)) AS t FROM vr)", VAR_SQL))
def g4(spark, sf_dir):
    v = variances(spark, sf_dir)
    return v.select("feature", r("variance", 4).alias("variance"), (F.col("variance") < SE.variance_floor(v)).alias("below_floor"))


CLUSTERS = [(c, i // 2) for i, c in enumerate(SEN)]


@query("g2_redundancy_clusters")
def g2(spark, sf_dir):
    wide = filled_named(spark, sf_dir)
    return SE.cluster_table(spark, NAMED, TB.correlation_matrix(wide, NAMED))


def filled_named(spark, sf_dir):
    wide = cut_lineage(named_features(spark, sf_dir).select("id", "y", *NAMED))
    return FE.fill_with(wide, FE.fit_medians(wide, NAMED))


@query("g24_complete_linkage_clusters")
def g24(spark, sf_dir):
    wide = filled_named(spark, sf_dir)
    return SE.cluster_table(spark, NAMED, TB.correlation_matrix(wide, NAMED), cut=0.1, method="complete")


@query("g3_cluster_representative", with_sql(ORDERS_SQL, f"""SELECT feature, cluster, CASE WHEN bool_or(feature IN {PROTECTED}) OVER (PARTITION BY cluster) THEN feature IN {PROTECTED} ELSE row_number() OVER (PARTITION BY cluster ORDER BY variance DESC, feature) = 1 END AS kept
 FROM (SELECT feature, variance, CAST((row_number() OVER (ORDER BY variance DESC, feature) - 1) // 2 AS INTEGER) AS cluster FROM vr)""", VAR_SQL))
def g3(spark, sf_dir):
    v = variances(spark, sf_dir)
    pairs = ((F.row_number().over(SE.everything().orderBy(F.desc("variance"), "feature")) - 1) / 2).cast("int")  # neighbours in variance
    clusters = v.select("feature", pairs.alias("cluster"))
    return SE.representatives(clusters, v.select("feature", F.col("variance").alias("importance")), PROTECTED)


@query("g5_drop_registry", with_sql(ORDERS_SQL, f"""SELECT feature, 'nan_drop' AS reason, {sr('ratio')} AS stat_value, {sr('threshold')} AS threshold, 'null gap' AS derivation FROM nr, gt WHERE ratio > threshold AND feature NOT IN {PROTECTED}
 UNION ALL SELECT feature, 'variance_drop', {sr('variance', 4)}, {sr('t', 4)}, 'P1 of variances' FROM vr, (SELECT greatest(1.1920928955078125e-07, quantile_cont(variance, 0.01)) AS t FROM vr) WHERE variance < t AND feature NOT IN {PROTECTED}""", STATS_SQL, NULLS_SQL, GAP_SQL, VAR_SQL))
def g5(spark, sf_dir):
    return registry(spark, sf_dir).select("feature", "reason", F.when(F.col("reason") == "nan_drop", r("stat_value")).otherwise(r("stat_value", 4)).alias("stat_value"), F.when(F.col("reason") == "nan_drop", r("threshold")).otherwise(r("threshold", 4)).alias("threshold"), "derivation")


def registry(spark, sf_dir):
    ratios, v = null_ratios(spark, sf_dir), variances(spark, sf_dir)
    nan = SE.drop_records(ratios, "ratio", SE.gap_threshold(ratios).select("threshold").scalar(), "nan_drop", "null gap", PROTECTED)
    return nan.unionByName(SE.drop_records(v, "variance", SE.variance_floor(v), "variance_drop", "P1 of variances", PROTECTED, below=True))


@query("a23_drop_summary", with_sql(ORDERS_SQL, f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'nan_drop' AS reason FROM nr, gt WHERE ratio > threshold AND feature NOT IN {PROTECTED} UNION ALL SELECT 'variance_drop' FROM vr, (SELECT greatest(1.1920928955078125e-07, quantile_cont(variance, 0.01)) AS t FROM vr) WHERE variance < t AND feature NOT IN {PROTECTED}) GROUP BY 1", STATS_SQL, NULLS_SQL, GAP_SQL, VAR_SQL))
def a23(spark, sf_dir):
    return registry(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def fitted_pruning(spark, sf_dir):
    """All decisions from the training side, clusters ranked by the gain of boosted trees; and the rows of both sides."""
    wide = cut_lineage(named_features(spark, sf_dir).select("id", "is_train", "y", *NAMED))
    gain = lambda rows, cols: MO.importances(MO.fit_regressor(rows, cols), cols)
    return PR.fit_pruning(wide.where("is_train"), NAMED, PROTECTED, gain), wide


@query("g3_fitted_representatives")
def g3_fitted(spark, sf_dir):
    return fitted_pruning(spark, sf_dir)[0].representatives


@query("g5_fitted_drop_registry")
def g5_fitted(spark, sf_dir):
    return fitted_pruning(spark, sf_dir)[0].records


@query("g6_manifest_on_test")
def g6(spark, sf_dir):
    fit, wide = fitted_pruning(spark, sf_dir)
    test = wide.where("NOT is_train").drop("y")
    return SE.sync_schema(fit.manifest.apply(test), NAMED, ["id", "is_train"], fit.manifest.dropped()).drop("is_train")


@query("g7_stable_filter", with_sql(ORDERS_SQL, f"SELECT feature, ks_stat < threshold OR feature IN {PROTECTED} AS stable FROM ks, th", *BASE, IMP_SQL, KNEE_SQL))
def g7(spark, sf_dir):
    d = drift_with_importance(spark, sf_dir)
    cut = drift.knee_threshold(d).select("threshold").scalar()
    return d.select("feature", ((F.col("ks_stat") < cut) | F.col("feature").isin(*PROTECTED)).alias("stable"))


@query("g17_pca_input_filter", with_sql(ORDERS_SQL, "SELECT feature FROM ks WHERE ks_stat <= 0.01 OR (SELECT count(*) FROM ks WHERE ks_stat <= 0.01) < 5", *BASE))
def g17(spark, sf_dir):
    k = sensor_ks(spark, sf_dir)
    n = k.agg(F.count_if(F.col("ks_stat") <= 0.01).alias("n")).scalar()
    return k.where((F.col("ks_stat") <= 0.01) | (n < 5)).select("feature")


LINEAGE = [(f"inter_{a}_x_{b}", p) for a, b in PAIRS for p in (a, b)] + [(f"ratio_{a}_to_{b}", p) for a, b in PAIRS for p in (a, b)] + [(f"{c}_rolling_mean_5", c) for c in SEN]


@query("j8_lineage_protection", with_sql(ORDERS_SQL, "SELECT child, bool_and(coalesce(ks_stat, 0) <= (SELECT quantile_cont(ks_stat, 0.5) FROM ks)) AS protected FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in LINEAGE) + ") l(child, parent) LEFT JOIN ks ON ks.feature = l.parent GROUP BY 1", *BASE))
def j8(spark, sf_dir):
    ks = sensor_ks(spark, sf_dir)
    median = ks.agg(F.percentile("ks_stat", F.lit(0.5)).alias("m")).scalar()  # one row per sensor
    return SE.protected_children(spark.createDataFrame(LINEAGE, "child string, parent string"), ks, median)


# --- gates ----------------------------------------------------------------------------------------------------

NOISE = [f"__noise_{i}__" for i in range(3)]
GCOLS = NAMED + NOISE
NOISE_SQL = "wn AS (SELECT *, id % 2 AS half, " + ", ".join(f"((id * {7919 + 2 * i} + {104729 * (i + 1)}) % 1009) / 1009.0::DOUBLE AS {n}" for i, n in enumerate(NOISE)) + " FROM wide)"
GLONG_SQL = f"gl AS (SELECT * FROM (UNPIVOT (SELECT y, is_train, half, abs(y - (SELECT avg(y) FROM op)) AS sp, {', '.join(GCOLS)} FROM wn) ON {', '.join(GCOLS)} INTO NAME feature VALUE v))"
LOG_SQL = """gc AS (SELECT feature, corr(v, y) AS mc, corr(v, sp) AS pc, corr(v, y) FILTER (half = 0) AS c0, corr(v, y) FILTER (half = 1) AS c1 FROM gl GROUP BY 1),
fl_ AS (SELECT feature, abs(mc) * 100 AS gain, abs(pc) * 0.05 AS perm_delta, abs(pc) * 0.05 / (abs(mc) * 100 + 1e-9) AS gen_ratio, mc AS marg_corr, ks_stat,
 CASE WHEN abs(c0) + abs(c1) > 0 THEN abs(abs(c0) - abs(c1)) * 50 / ((abs(c0) + abs(c1)) * 50 + 1e-9) ELSE 1.0 END AS gain_cv, abs(sign(c0) + sign(c1)) / 2.0 AS sign_stability, starts_with(feature, '__noise_') AS is_noise FROM gc JOIN gk USING (feature)),
lm AS (SELECT greatest(coalesce(max(gain) FILTER (is_noise), 0) * 1.2, quantile_cont(gain, 0.2) FILTER (NOT is_noise)) AS lg, coalesce(max(perm_delta) FILTER (is_noise), 0) AS lp, least(greatest(quantile_cont(ks_stat, 0.9) FILTER (NOT is_noise), 0.1), 0.25) AS lk FROM fl_),
g0 AS (SELECT fl_.*, lg, lp, lk, starts_with(feature, 'inter_') AS it, regexp_matches(feature, '_slope_|_rate_|_diff_|_std_|_volatility_') OR regexp_matches(feature, '^(inter_|ratio_|diff_|logprod_)') AS cx FROM fl_, lm WHERE NOT is_noise),
g1 AS (SELECT *, gain > lg AS beats_noise_gain, perm_delta > greatest(lp * CASE WHEN cx THEN 1.0 ELSE 1.5 END, CASE WHEN cx THEN 0.001 ELSE 0.002 END * CASE WHEN regexp_matches(feature, '^(ratio_|diff_)') THEN 0.5 ELSE 1.0 END) AS beats_noise_perm,
 perm_delta > greatest(lp, 0.001) AND (sign_stability >= 0.66 OR perm_delta > 0.004) AS sig, ks_stat <= lk AS calm, NOT it OR perm_delta > 0.001 AS itk FROM g0),
gg AS (SELECT *, (beats_noise_gain OR beats_noise_perm) AND sig AND calm AND itk AS passed, list_filter([CASE WHEN NOT (beats_noise_gain OR beats_noise_perm) THEN 'NoiseCeiling' END, CASE WHEN NOT sig THEN 'SignInstability' END, CASE WHEN NOT calm THEN 'DriftRisk' END,
 CASE WHEN NOT itk THEN 'RedundantInteraction' END], lambda x: x IS NOT NULL) AS rejection_reasons FROM g1)"""
G_BASE = (STATS_SQL, NOISE_SQL, GLONG_SQL, "gsd AS (SELECT feature, v, is_train AS a FROM gl)", ks_sql("gsd", "gk"), LOG_SQL)


def gated(spark, sf_dir):
    """The validation log of the named features, with hashed noise columns as negative control."""
    return SE.gate(raw_log(spark, sf_dir))


def raw_log(spark, sf_dir):
    noise = {n: ((F.col("id") * (7919 + 2 * i) + 104729 * (i + 1)) % 1009 / 1009.0) for i, n in enumerate(NOISE)}
    rows = named_features(spark, sf_dir).withColumns(noise).withColumn("half", F.col("id") % 2)
    rows = cut_lineage(rows.select("y", "half", "is_train", *GCOLS))  # three passes read it
    return SE.feature_log(rows, GCOLS, drift.ks_table(rows, GCOLS, F.col("is_train")))


@query("g13_validation_gates", with_sql(ORDERS_SQL, f"SELECT feature, {sr('gain', 5)} AS gain, {sr('perm_delta')} AS perm_delta, {sr('marg_corr')} AS marg_corr, {sr('ks_stat')} AS ks_stat, {sr('gain_cv', 4)} AS gain_cv, {sr('sign_stability')} AS sign_stability, beats_noise_gain, beats_noise_perm, passed, array_to_string(rejection_reasons, ',') AS reasons FROM gg", *G_BASE))
def g13(spark, sf_dir):
    return gated(spark, sf_dir).select(
        "feature", r("gain", 5).alias("gain"), r("perm_delta").alias("perm_delta"), r("marg_corr").alias("marg_corr"), r("ks_stat").alias("ks_stat"), r("gain_cv", 4).alias("gain_cv"), r("sign_stability").alias("sign_stability"),
        "beats_noise_gain", "beats_noise_perm", "passed", F.concat_ws(",", "rejection_reasons").alias("reasons"),
    )


@query("a21_rejection_reasons", with_sql(ORDERS_SQL, "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(rejection_reasons) AS reason FROM gg) GROUP BY 1", *G_BASE))
def a21(spark, sf_dir):
    return gated(spark, sf_dir).select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a19_category_survival", with_sql(ORDERS_SQL, f"SELECT {CATEGORY_SQL} AS category, CAST(count(*) AS BIGINT) AS total, CAST(count_if(passed) AS BIGINT) AS survived, CAST(count_if(NOT passed) AS BIGINT) AS rejected FROM gg GROUP BY 1", *G_BASE))
def a19(spark, sf_dir):
    g = gated(spark, sf_dir)
    return g.groupBy(N.category(F.col("feature")).alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("survived"), F.count_if(~F.col("passed")).alias("rejected"))


RS_SQL = "rs AS (SELECT *, pg + pp_ + 3 * pk AS score FROM (SELECT *, (rank() OVER (ORDER BY gain) + (count(*) OVER (PARTITION BY gain) - 1) / 2.0) / count(*) OVER () AS pg, (rank() OVER (ORDER BY perm_delta) + (count(*) OVER (PARTITION BY perm_delta) - 1) / 2.0) / count(*) OVER () AS pp_, (rank() OVER (ORDER BY ks_stat DESC) + (count(*) OVER (PARTITION BY ks_stat) - 1) / 2.0) / count(*) OVER () AS pk FROM gg))"


@query("g15_rank_score", with_sql(ORDERS_SQL, f"SELECT feature, {sr('score')} AS score, {CATEGORY_SQL} AS bucket, row_number() OVER (PARTITION BY {CATEGORY_SQL} ORDER BY round(score::DOUBLE, 9) DESC, feature) = 1 AS best_in_bucket FROM rs", *G_BASE, RS_SQL))
def g15(spark, sf_dir):
    s = SE.rank_score(gated(spark, sf_dir)).withColumn("bucket", N.category(F.col("feature")))
    best = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc(F.round("score", 9)), "feature")) == 1
    return s.select("feature", r("score").alias("score"), "bucket", best.alias("best_in_bucket"))


@query("g16_noise_immunity", with_sql(ORDERS_SQL, f"SELECT {sr('max(gain) FILTER (is_noise)', 5)} AS noise_max_gain, {sr('count_if(is_noise AND gain > lg) * 1.0 / count_if(is_noise)')} AS noise_survival_rate, (SELECT {sr('-sum(g / s * ln(g / s + 1e-9))', 5)} FROM (SELECT gain AS g, sum(gain) OVER () AS s FROM fl_ WHERE NOT is_noise)) AS usage_entropy FROM fl_, lm", *G_BASE))
def g16(spark, sf_dir):
    log = raw_log(spark, sf_dir)
    s = F.sum(F.when(~F.col("is_noise"), F.col("gain"))).over(SE.everything())
    share = F.col("gain") / F.col("s")
    top = F.max(F.when(F.col("is_noise"), F.col("gain")))
    cut = log.agg(F.greatest(top * 1.2, F.percentile(F.when(~F.col("is_noise"), F.col("gain")), F.lit(0.2))).alias("c")).scalar()
    n = log.withColumn("s", s).agg(
        r(top, 5).alias("noise_max_gain"), r(F.count_if(F.col("is_noise") & (F.col("gain") > cut)) / F.count_if("is_noise")).alias("noise_survival_rate"), r(-F.sum(F.when(~F.col("is_noise"), share * F.ln(share + 1e-9))), 5).alias("usage_entropy")
    )
    return n


@query("g14_greedy_redundancy")
def g14(spark, sf_dir):
    g = gated(spark, sf_dir).orderBy(F.desc("gain"), "feature").select("feature", "gain").collect()  # one row per feature
    m = TB.correlation_matrix(filled_named(spark, sf_dir), NAMED)
    at = {c: i for i, c in enumerate(NAMED)}
    corr = {(a, b): float(m[at[a], at[b]]) for a in NAMED for b in NAMED if a != b}
    kept = SE.greedy_uncorrelated([x.feature for x in g], corr)
    return spark.createDataFrame([(f, i) for i, f in enumerate(kept)], "feature string, position int")


@query("g22_correlated_pairs", with_sql(ORDERS_SQL, f"SELECT feature_a, feature_b, {sr('abs(corr)')} AS abs_corr FROM ({corr_pairs_sql(SEN, 'fl')}) WHERE abs(corr) > 0.6", CORR_SQL))
def g22(spark, sf_dir):
    return TB.correlation_pairs(filled(spark, sf_dir), SEN).where(F.abs("corr") > 0.6).select("feature_a", "feature_b", r(F.abs("corr")).alias("abs_corr"))


@query("g19_category_redundancy", with_sql(ORDERS_SQL, f"SELECT cat AS category, {sr('avg(abs(corr))')} AS mean_corr, CAST(count(*) AS BIGINT) AS n_pairs FROM (SELECT split_part(feature_a, '_', 1) AS cat, corr FROM ({corr_pairs_sql(SEN, 'fl')}) WHERE split_part(feature_a, '_', 1) = split_part(feature_b, '_', 1)) GROUP BY 1", CORR_SQL))
def g19(spark, sf_dir):
    a, b = F.split("feature_a", "_")[0], F.split("feature_b", "_")[0]
    pairs = TB.correlation_pairs(filled(spark, sf_dir), SEN).where(a == b)
    return pairs.groupBy(a.alias("category")).agg(r(F.avg(F.abs("corr"))).alias("mean_corr"), F.count(F.lit(1)).alias("n_pairs"))


@query("g25_interaction_redundancy", with_sql(ORDERS_SQL, " UNION ALL ".join(f"SELECT 'inter_{a}_x_{b}' AS feature, {sr(f'greatest(abs(corr({a} * {b}, {a})), abs(corr({a} * {b}, {b})))')} AS max_corr FROM op" for a, b in PAIRS)))
def g25(spark, sf_dir):
    op = S.order_panel(spark, sf_dir)
    wide = op.agg(*[F.greatest(F.abs(X.corr(F.col(a) * F.col(b), a)), F.abs(X.corr(F.col(a) * F.col(b), b))).alias(f"inter_{a}_x_{b}") for a, b in PAIRS])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), r(c).alias("max_corr")) for c in wide.columns])))


@query("g26_gain_elbow", with_sql(ORDERS_SQL, f"SELECT feature, {sr('gain', 5)} AS elbow_gain, {sr('gain - nx', 5)} AS fall FROM (SELECT feature, gain, lead(gain) OVER (ORDER BY gain DESC, feature) AS nx FROM gg) WHERE nx IS NOT NULL ORDER BY round(gain - nx, 9) DESC, feature LIMIT 1", *G_BASE))
def g26(spark, sf_dir):
    nx = F.lead("gain").over(SE.everything().orderBy(F.desc("gain"), "feature"))
    falls = gated(spark, sf_dir).select("feature", "gain", nx.alias("nx")).where("nx IS NOT NULL").withColumn("fall", F.col("gain") - F.col("nx"))
    return falls.orderBy(F.desc(F.round("fall", 9)), "feature").limit(1).select("feature", r("gain", 5).alias("elbow_gain"), r("fall", 5).alias("fall"))


@query("w20_cumulative_importance", with_sql(ORDERS_SQL, f"SELECT cutoff, CAST(greatest(1, count_if(cum <= cutoff)) AS BIGINT) AS n_features FROM (SELECT sum(gain) OVER (ORDER BY gain DESC, feature) / sum(gain) OVER () AS cum FROM gg), (SELECT unnest([0.1, 0.5, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS cutoff) GROUP BY 1", *G_BASE))
def w20(spark, sf_dir):
    run = SE.everything().orderBy(F.desc("gain"), "feature").rowsBetween(W.unboundedPreceding, 0)
    cum = gated(spark, sf_dir).select((F.sum("gain").over(run) / F.sum("gain").over(SE.everything())).alias("cum"))
    cuts = (0.1, 0.5, 0.8, 0.9, 0.95, 0.99)
    wide = cum.agg(*[F.greatest(F.lit(1).cast("long"), F.count_if(F.col("cum") <= c)).alias(f"c{i}") for i, c in enumerate(cuts)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"c{i}").alias("n_features")) for i, c in enumerate(cuts)])))


REGATE_SQL = "rg AS (SELECT feature, passed, list_filter([CASE WHEN NOT gain > greatest(0.2, q20) THEN 'Gain' END, CASE WHEN NOT (perm_delta > 0 AND gen_ratio > CASE WHEN ks_stat > 0.5 AND ks_stat <= 0.85 THEN 0.0015 ELSE 0.00075 END) THEN 'GenRatio' END, CASE WHEN NOT abs(marg_corr) >= 0.0001 THEN 'MargCorr' END, CASE WHEN NOT ks_stat <= 0.85 THEN 'KS' END], lambda x: x IS NOT NULL) AS nr FROM gg, (SELECT quantile_cont(gain, 0.2) AS q20 FROM gg))"


@query("g27_regating", with_sql(ORDERS_SQL, "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(passed) AS BIGINT) AS passed_before, CAST(count_if(len(nr) = 0) AS BIGINT) AS passed_after, CAST(count_if(passed <> (len(nr) = 0)) AS BIGINT) AS changed FROM rg", *G_BASE, REGATE_SQL))
def g27(spark, sf_dir):
    g = gated(spark, sf_dir)
    q20 = g.agg(F.percentile("gain", F.lit(0.2)).alias("q")).scalar()
    danger = (F.col("ks_stat") > 0.5) & (F.col("ks_stat") <= 0.85)
    keep = (
        (F.col("gain") > F.greatest(F.lit(0.2), q20)) & (F.col("perm_delta") > 0) & (F.col("gen_ratio") > F.when(danger, 0.0015).otherwise(0.00075)) & (F.abs("marg_corr") >= 0.0001) & (F.col("ks_stat") <= 0.85)
    )
    g = g.withColumn("again", keep)
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed_before"), F.count_if("again").alias("passed_after"), F.count_if(F.col("passed") != F.col("again")).alias("changed"))


@query("g23_rejection_post_mortem", with_sql(ORDERS_SQL, f"SELECT feature, {sr('perm_delta')} AS perm_delta, list_contains(rejection_reasons, 'NoiseCeiling') AND perm_delta > 0 AS noise_but_useful, list_contains(rejection_reasons, 'SignInstability') AND perm_delta > 0.001 AS unstable_but_strong FROM gg WHERE NOT passed ORDER BY gg.perm_delta DESC, feature LIMIT 10", *G_BASE))
def g23(spark, sf_dir):
    has = lambda x: F.array_contains("rejection_reasons", x)
    d = F.col("perm_delta")
    worst = gated(spark, sf_dir).where(~F.col("passed")).orderBy(F.desc("perm_delta"), "feature").limit(10)
    return worst.select("feature", r("perm_delta").alias("perm_delta"), (has("NoiseCeiling") & (d > 0)).alias("noise_but_useful"), (has("SignInstability") & (d > 0.001)).alias("unstable_but_strong"))


SIDE_PASS = "sp_ AS (SELECT feature, abs(corr(v, y) FILTER (is_train)) > 0.004 AS p1, abs(corr(v, y) FILTER (NOT is_train)) > 0.004 AS p2 FROM lg GROUP BY 1)"


@query("r36_cross_run_stability", with_sql(ORDERS_SQL, "SELECT feature, CASE WHEN coalesce(p1, false) AND coalesce(p2, false) THEN 'both' WHEN coalesce(p1, false) THEN 'only_1' ELSE 'only_2' END AS status FROM sp_ WHERE coalesce(p1, false) OR coalesce(p2, false)", LONG_SQL, SIDE_PASS))
def r36(spark, sf_dir):
    a, y = F.col("is_train"), F.col("y")
    s = drift.stats_long(S.order_panel(spark, sf_dir), SEN, p1=lambda c: F.abs(X.corr(F.when(a, c), y)), p2=lambda c: F.abs(X.corr(F.when(~a, c), y)))
    one, two = s.where("p1 > 0.004").select("feature", F.lit(True).alias("a")), s.where("p2 > 0.004").select("feature", F.lit(True).alias("b"))
    status = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_1").otherwise("only_2")
    return one.join(two, "feature", "full_outer").select("feature", status.alias("status"))


@query("r25_feature_health")
def r25(spark, sf_dir):
    """Largest |correlation| and the condition number, from the p x p Gram matrix of the rows."""
    rows = filled(spark, sf_dir).select(*SEN)
    pairs = [(a, b) for i, a in enumerate(SEN) for b in SEN[i:]]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"g{i}") for i, (a, b) in enumerate(pairs)]).first()
    gram = np.zeros((len(SEN), len(SEN)))
    for i, (a, b) in enumerate(pairs):
        gram[SEN.index(a), SEN.index(b)] = gram[SEN.index(b), SEN.index(a)] = sums[f"g{i}"]
    eig = np.linalg.eigvalsh(gram)
    cond = float(np.sqrt(eig[-1] / eig[0])) if eig[0] > 0 else float("inf")
    top = TB.correlation_pairs(rows, SEN).agg(F.max(F.abs("corr")).alias("correlation_max"))
    return top.withColumn("condition_number", F.lit(cond)).withColumn("feature_count", F.lit(len(SEN)))
