"""Metric, verdict and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators import drift, metrics as M, ranks, tables as TB
from panelforge.operators.prefix import row_positions
from panelforge.operators.quantiles import fit_quantiles
from panelforge.plans.aggregates import CLASS_SQL, CORR_SQL, RANK_SQL, TAIL_SQL, corr_pairs_sql, filled, outcome, q, ranked, tailed
from panelforge.plans.drift_audit import QQ, spearman
from panelforge.plans.registry import ORDERS_SQL, PRED_SQL, query, r, sr, with_sql
from panelforge.sources import panels as S

V_SQL = "vp AS (SELECT *, abs(y - oof) AS e, abs(y - nt) AS b FROM tl WHERE oof IS NOT NULL)"
PV = (TAIL_SQL, V_SQL)


def c_y():
    return F.col("y")


def c_oof():
    return F.col("oof")


def c_nt():
    return F.col("nt")


def c_t():
    return F.col("t")


def c_p():
    return F.col("p")


def c_w():
    return F.col("w")


def c_err():
    return F.abs(c_y() - c_oof())


def c_gain():
    """What taking the tail model instead of the bulk one saves on a row."""
    return F.abs(c_y() - c_nt()) - F.abs(c_y() - c_t())




def preds(spark, sf_dir):
    return S.pred_panel(spark, sf_dir)


def valid(spark, sf_dir):
    return tailed(spark, sf_dir).where("has_oof")


def sql(body, *more):
    return with_sql(PRED_SQL, body, *PV, *more)


Q_SQL = "qy AS (SELECT quantile_cont(y, 0.0) AS y0, quantile_cont(y, 0.5) AS y50, quantile_cont(y, 0.9) AS y90, quantile_cont(y, 0.99) AS y99, quantile_cont(y, 1.0) AS y100, quantile_cont(e, 0.9) AS e90, quantile_cont(e, 0.99) AS e99, quantile_cont(oof, 0.5) AS o50, quantile_cont(oof, 0.9) AS o90, quantile_cont(oof, 0.99) AS o99 FROM vp)"
MET_SQL = """me AS (SELECT avg(e) AS mae, sqrt(avg(e * e)) AS rmse, quantile_cont(e, 0.5) AS med_ae, avg(oof) / (avg(y) + 1e-9) AS mean_ratio, stddev_pop(oof) / (stddev_pop(y) + 1e-9) AS std_ratio,
 any_value(o50 / (y50 + 1e-9)) AS p50_ratio, any_value(o90 / (y90 + 1e-9)) AS p90_ratio, any_value(o99 / (y99 + 1e-9)) AS p99_ratio,
 avg(e) FILTER (rn <= n // 2) AS mae_bottom_50, avg(e) FILTER (e >= e90) AS mae_top_10, avg(e) FILTER (e >= e99) AS mae_top_1, avg(e) FILTER (y >= y0 AND y <= y50) AS Q0_50_mae, avg(e) FILTER (y >= y50 AND y <= y90) AS Q50_90_mae,
 avg(e) FILTER (y >= y90 AND y <= y99) AS Q90_99_mae, avg(e) FILTER (y >= y99 AND y <= y100) AS Q99_100_mae, coalesce(avg(e - b) FILTER (e > b), 0) AS fp_cost, sum(greatest(0.0, b - e)) / (sum(b) + 1e-9) AS gain_capture
 FROM (SELECT *, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS n FROM vp), qy),
fo AS (SELECT avg(m) AS cv_mean, stddev_pop(m) AS cv_std FROM (SELECT avg(e) AS m FROM vp GROUP BY fold)),
au AS (SELECT (sum(CASE WHEN fold = 4 THEN rk END) - count_if(fold = 4) * (count_if(fold = 4) + 1) / 2.0) / (count_if(fold = 4) * 1.0 * count_if(fold <> 4)) AS adv_auc FROM
 (SELECT fold, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rk FROM pp)),
al AS (SELECT *, cv_std / (cv_mean + 1e-9) * 10.0 AS divergence, greatest(0.0, adv_auc - 0.5) * 8.0 AS adversarial, abs(1.0 - std_ratio) * 4.0 + abs(1.0 - mean_ratio) * 2.0 AS distribution, Q99_100_mae / mae * 0.2 AS tail_risk FROM me, fo, au)"""
MET_NAMES = ("mae rmse med_ae mean_ratio std_ratio p50_ratio p90_ratio p99_ratio mae_bottom_50 mae_top_10 mae_top_1 Q0_50_mae Q50_90_mae Q90_99_mae Q99_100_mae fp_cost gain_capture").split()


@query("r1_build_metrics", sql("SELECT " + ", ".join(f"{sr(n, 4)} AS {n}" for n in MET_NAMES) + " FROM me", Q_SQL, MET_SQL))
def r1(spark, sf_dir):
    return M.build_metrics(preds(spark, sf_dir), "y", "oof", "nt").select(*[r(n, 4).alias(n) for n in MET_NAMES])


def metric_row(spark, sf_dir):
    """Metrics with fold spread, adversarial AUC of the last fold and the total risk attached."""
    pp = preds(spark, sf_dir)
    m = M.build_metrics(pp, "y", "oof", "nt")
    spread = M.fold_spread(M.fold_maes(pp, "fold", "y", "oof"))
    s = spread.select(F.struct("cv_mean", "cv_std").alias("s")).scalar()
    auc = ranks.roc_auc(pp, [], "y", F.col("fold") == 4).select("auc").scalar()
    return m.withColumn("_s", s).withColumn("adv_auc", auc).select("*", "_s.*").drop("_s")


@query("r2_std_mean_ratio", sql(f"SELECT {sr('stddev_pop(oof) / ((SELECT stddev_pop(y) FROM pp) + 1e-9)')} AS std_ratio, {sr('avg(oof) / ((SELECT avg(y) FROM pp) + 1e-9)')} AS mean_ratio, stddev_pop(oof) / ((SELECT stddev_pop(y) FROM pp) + 1e-9) BETWEEN 0.1 AND 2.0 AS within_guard FROM vp"))
def r2(spark, sf_dir):
    m = preds(spark, sf_dir).agg(F.stddev_pop("oof").alias("ps"), F.avg("oof").alias("pm"), F.stddev_pop("y").alias("ts"), F.avg("y").alias("tm"))
    std = F.col("ps") / (F.col("ts") + 1e-9)
    return m.select(r(std).alias("std_ratio"), r(F.col("pm") / (F.col("tm") + 1e-9)).alias("mean_ratio"), std.between(0.1, 2.0).alias("within_guard"))


@query("r3_distribution_auditor", sql(f"SELECT {sr('stddev_pop(oof) / (stddev_pop(y) + 1e-9)')} AS std_ratio, {sr('any_value(o99 / (y99 + 1e-9))')} AS p99_ratio, {sr('avg(e) FILTER (y > y99)', 3)} AS q99_mae FROM vp, qy", Q_SQL))
def r3(spark, sf_dir):
    v = preds(spark, sf_dir).where("has_oof")
    got = fit_quantiles(v, {"y": (c_y(), [0.99]), "o": (c_oof(), [0.99])})
    y99, o99 = got["y"][0], got["o"][0]
    return v.agg(r(F.stddev_pop("oof") / (F.stddev_pop("y") + 1e-9)).alias("std_ratio"), r(F.avg(F.when(c_y() > y99, c_err())), 3).alias("q99_mae")).withColumn("p99_ratio", r(F.lit(o99 / (y99 + 1e-9))))


RISKS = ("divergence", "adversarial", "distribution", "tail", "total")


@query("r4_risk_score", sql(f"SELECT {sr('divergence')} AS divergence, {sr('adversarial')} AS adversarial, {sr('distribution')} AS distribution, {sr('tail_risk')} AS tail, {sr('divergence + adversarial + distribution + tail_risk')} AS total FROM al", Q_SQL, MET_SQL))
def r4(spark, sf_dir):
    return metric_row(spark, sf_dir).select(*[r(c).alias(n) for n, c in M.risk_parts().items()])


@query("r5_cv_reliability", sql(f"""SELECT {sr('a')} AS adversarial_penalty, {sr('v')} AS variance_penalty, {sr('b')} AS bias_penalty, {sr('1 / (1 + a + v + b)')} AS reliability_score, {sr('cv_std / (cv_mean + 1e-9)')} AS fold_cov,
 CASE WHEN 1 / (1 + a + v + b) > 0.7 THEN 'RELIABLE' WHEN 1 / (1 + a + v + b) > 0.4 THEN 'PARTIAL' ELSE 'UNRELIABLE' END AS interpretation FROM (SELECT *, greatest(0.0, (adv_auc - 0.5) / 0.5) * 1.5 AS a, greatest(0.0, 1.0 - std_ratio) AS v, abs(1.0 - mean_ratio) * 0.5 AS b FROM al)""", Q_SQL, MET_SQL))
def r5(spark, sf_dir):
    rel = M.reliability(F.col("adv_auc"), F.col("std_ratio"), F.col("mean_ratio"))
    text = rel.pop("interpretation")
    return metric_row(spark, sf_dir).select(*[r(c).alias(n) for n, c in rel.items()], r(F.col("cv_std") / (F.col("cv_mean") + 1e-9)).alias("fold_cov"), text.alias("interpretation"))


IDX_SQL = {
    "external_drift": "(adv_auc - 0.7) / 0.3", "global_bias": "abs(1.0 - mean_ratio) / 0.3", "variance_compression": "(1.0 - std_ratio) / 0.5", "cv_reliability": "cv_std / cv_mean / 0.2",
    "tail_residual": "(1.0 - p99_ratio) / 0.7", "prediction_cap": "(0.5 - p99_ratio) / 0.2", "feature_blindness": "(mae_top_1 / (mae + 1e-9) - 5) / 10", "temporal_discontinuity": "(adv_auc - 0.9) / 0.1",
    "generalisation_gap": "(divergence + adversarial + distribution + tail_risk) / 10.0",
}


@query("r6_risk_indices", sql(f"SELECT risk, {sr('v', 4)} AS value, CASE WHEN v > 80 THEN 'CRITICAL' WHEN v > 40 THEN 'WARNING' ELSE 'HEALTHY' END AS status, CAST(row_number() OVER (ORDER BY round(v, 6) DESC, risk) AS INTEGER) AS position FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS risk, least(100.0, greatest(0.0, ({e}) * 100.0)) AS v FROM al" for n, e in IDX_SQL.items()) + ")", Q_SQL, MET_SQL))
def r6(spark, sf_dir):
    row = metric_row(spark, sf_dir).withColumn("total", M.risk_parts()["total"])
    cells = [F.struct(F.lit(n).alias("risk"), c.alias("v")) for n, c in M.risk_indices().items()]
    long = row.select(F.inline(F.array(*cells)))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("v", 6)), "risk")  # nine rows
    status = F.when(F.col("v") > 80, "CRITICAL").when(F.col("v") > 40, "WARNING").otherwise("HEALTHY")
    return long.select("risk", r("v", 4).alias("value"), status.alias("status"), F.row_number().over(w).alias("position"))


@query("r7_execution_verdict", sql("SELECT CASE WHEN fp_cost > 1.0 THEN 'OVER-AGGRESSIVE' WHEN gain_capture < 0.05 THEN 'TOO CAUTIOUS' ELSE 'OPTIMIZED' END AS verdict, CASE WHEN p99_ratio > 0.5 THEN 'SUCCESS' ELSE 'CRITICAL' END AS p99_status FROM me", Q_SQL, MET_SQL))
def r7(spark, sf_dir):
    m = M.build_metrics(preds(spark, sf_dir), "y", "oof", "nt")
    return m.select(M.execution_verdict(F.col("fp_cost"), F.col("gain_capture")).alias("verdict"), F.when(F.col("p99_ratio") > 0.5, "SUCCESS").otherwise("CRITICAL").alias("p99_status"))


def auc_sql(score, label, src, group=""):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    tie = f"PARTITION BY {g}{score}"
    return f"""(SELECT {g}(sum(CASE WHEN lab THEN rk END) - count_if(lab) * (count_if(lab) + 1) / 2.0) / nullif(count_if(lab) * 1.0 * count_if(NOT lab), 0) AS auc, count_if(lab) AS n_pos, count_if(NOT lab) AS n_neg FROM
 (SELECT {g}{label} AS lab, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0 AS rk FROM {src}){' GROUP BY ' + group if group else ''})"""


@query("r8_roc_auc", sql(f"SELECT {sr('auc')} AS auc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM {auc_sql('p', 'tail', 'tl')}"))
def r8(spark, sf_dir):
    return ranks.roc_auc(tailed(spark, sf_dir), [], "p", F.col("tail")).select(r("auc").alias("auc"), "n_pos", "n_neg")


PR_SQL = """pt AS (SELECT p, tp * 1.0 / (tp + fp) AS precision, tp * 1.0 / pos AS recall, coalesce(lag(tp * 1.0 / pos) OVER (ORDER BY p DESC), 0) AS pr, coalesce(lag(tp * 1.0 / (tp + fp)) OVER (ORDER BY p DESC), 1.0) AS pp_ FROM
 (SELECT p, sum(a) OVER (ORDER BY p DESC) AS tp, sum(b) OVER (ORDER BY p DESC) AS fp, sum(a) OVER () AS pos FROM (SELECT p, count_if(tail) AS a, count_if(NOT tail) AS b FROM tl GROUP BY 1))),
pf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pt)"""


@query("r9_pr_curve", sql(f"SELECT p, {sr('precision')} AS precision, {sr('recall')} AS recall FROM pf", PR_SQL))
def r9(spark, sf_dir):
    return ranks.pr_points(tailed(spark, sf_dir), [], "p", F.col("tail")).select("p", r("precision").alias("precision"), r("recall").alias("recall"))


@query("r9_pr_summary", sql(f"SELECT {sr('sum((recall - pr) * (precision + pp_) / 2)')} AS pr_auc, {sr('sum((recall - pr) * precision)')} AS average_precision, {sr('max(f1)')} AS best_f1, (SELECT p FROM pf ORDER BY round(f1::DOUBLE, 12) DESC, p DESC LIMIT 1) AS best_threshold FROM pf", PR_SQL))
def r9b(spark, sf_dir):
    s = M.pr_summary(tailed(spark, sf_dir), "p", F.col("tail"))
    return s.select(r("pr_auc").alias("pr_auc"), r("average_precision").alias("average_precision"), r("best_f1").alias("best_f1"), "best_threshold")


CAL_BIN = "CAST(" + " + ".join(f"(p > {i / 10})::INT" for i in range(1, 10)) + " AS INTEGER)"
TENTHS = [i / 10 for i in range(11)]


@query("r10_calibration_curve", sql(f"SELECT {CAL_BIN} AS bin, {sr('avg(tail::INT)')} AS prob_true, {sr('avg(p)')} AS prob_pred, CAST(count(*) AS BIGINT) AS n FROM tl GROUP BY 1"))
def r10(spark, sf_dir):
    return calibration(tailed(spark, sf_dir)).select("bin", r("prob_true").alias("prob_true"), r("prob_pred").alias("prob_pred"), "n")


def calibration(df):
    return df.groupBy(X.right_closed_bin(c_p(), TENTHS).alias("bin")).agg(F.avg(F.col("tail").cast("double")).alias("prob_true"), F.avg("p").alias("prob_pred"), F.count(F.lit(1)).alias("n"))


@query("r10_brier_ece", sql(f"SELECT {sr('sum(abs(t - c) * n) / sum(n)')} AS ece, (SELECT {sr('avg((p - tail::INT) * (p - tail::INT))')} FROM tl) AS brier FROM (SELECT {CAL_BIN} AS bin, avg(tail::INT) AS t, avg(p) AS c, count(*) AS n FROM tl GROUP BY 1)"))
def r10b(spark, sf_dir):
    t = tailed(spark, sf_dir)
    d = c_p() - F.col("tail").cast("double")
    brier = t.agg(F.avg(d * d).alias("b")).scalar()
    gap = F.abs(F.col("prob_true") - F.col("prob_pred")) * F.col("n")
    return calibration(t).agg(r(F.sum(gap) / F.sum("n")).alias("ece")).withColumn("brier", r(brier))


@query("r11_precision_recall_at_threshold", sql(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, CAST(count_if(p > {t}) AS BIGINT) AS n, {sr(f'count_if(tail AND p > {t}) * 1.0 / count_if(p > {t})')} AS precision, {sr(f'count_if(tail AND p > {t}) * 1.0 / count_if(tail)')} AS recall FROM tl" for t in (0.5, 0.7, 0.8, 0.9))))
def r11(spark, sf_dir):
    pols = {str(t): c_p() > t for t in (0.5, 0.7, 0.8, 0.9)}
    tail = F.col("tail")
    m = M.policy_table(tailed(spark, sf_dir), pols, n=F.count_if, precision=lambda c: F.try_divide(F.count_if(tail & c), F.count_if(c)), recall=lambda c: F.try_divide(F.count_if(tail & c), F.count_if(tail)))
    return m.select(F.col("method").cast("double").alias("threshold"), "n", r("precision").alias("precision"), r("recall").alias("recall"))


GATES = {"top_5": "rp <= 0.05", "hybrid": "rp <= 0.10 AND t > nt * 1.5"}


@query("r12_gate_damage_gain", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT '{n}' AS method, {sr(f'sum(greatest(0.0, abs(CASE WHEN {g} THEN t ELSE nt END - y) - abs(nt - y)))', 1)} AS fp_damage, {sr(f'sum(greatest(0.0, abs(nt - y) - abs(CASE WHEN {g} THEN t ELSE nt END - y)))', 1)} AS gain, {sr(f'avg(abs(CASE WHEN {g} THEN t ELSE nt END - y)) FILTER (tail)', 3)} AS tail_mae FROM rk" for n, g in GATES.items()), TAIL_SQL, RANK_SQL))
def r12(spark, sf_dir):
    b = F.abs(c_nt() - c_y())
    pols = {n: F.abs(F.when(F.expr(g), c_t()).otherwise(c_nt()) - c_y()) for n, g in GATES.items()}
    m = M.policy_table(ranked(spark, sf_dir), pols, fp_damage=lambda e: F.sum(F.greatest(F.lit(0.0), e - b)), gain=lambda e: F.sum(F.greatest(F.lit(0.0), b - e)), tail_mae=lambda e: F.avg(F.when(F.col("tail"), e)))
    return m.select("method", r("fp_damage", 1).alias("fp_damage"), r("gain", 1).alias("gain"), r("tail_mae", 3).alias("tail_mae"))


@query("r13_fp_fn_cost", sql(f"SELECT {sr('fp', 3)} AS fp_cost, {sr('fn', 3)} AS fn_cost, {sr('fp / fn', 5)} AS cost_ratio FROM (SELECT avg(abs(y - t) - abs(y - nt)) FILTER (NOT tail) AS fp, avg(abs(y - nt) - abs(y - t)) FILTER (tail) AS fn FROM tl)"))
def r13(spark, sf_dir):
    g = F.abs(c_y() - c_t()) - F.abs(c_y() - c_nt())
    m = tailed(spark, sf_dir).agg(F.avg(F.when(~F.col("tail"), g)).alias("fp"), F.avg(F.when(F.col("tail"), -g)).alias("fn"))
    return m.select(r("fp", 3).alias("fp_cost"), r("fn", 3).alias("fn_cost"), r(F.try_divide("fp", "fn"), 5).alias("cost_ratio"))


@query("r14_delay_segments", sql(f"SELECT CASE WHEN y < 100000 THEN 'low' WHEN y <= 300000 THEN 'mid' ELSE 'high' END AS segment, {sr('avg(e)', 3)} AS mae, CAST(count(*) AS BIGINT) AS n FROM vp GROUP BY 1"))
def r14(spark, sf_dir):
    seg = F.when(c_y() < 100000, "low").when(c_y() <= 300000, "mid").otherwise("high")
    return M.segment_report(preds(spark, sf_dir), seg).select("segment", r("mae", 3).alias("mae"), "n")


@query("r15_quantile_segments", sql(f"SELECT CASE WHEN y <= y50 THEN 'bottom_50' WHEN y <= y90 THEN '50_90' WHEN y <= y99 THEN '90_99' ELSE 'top_1' END AS segment, {sr('avg(e)', 3)} AS mae, {sr('avg(oof - y)', 3)} AS bias, CAST(count(*) AS BIGINT) AS n FROM vp, qy GROUP BY 1", Q_SQL))
def r15(spark, sf_dir):
    v = preds(spark, sf_dir).where("has_oof")
    a, b, c = q(v, "y", 0.5, 0.9, 0.99)
    seg = F.when(c_y() <= a, "bottom_50").when(c_y() <= b, "50_90").when(c_y() <= c, "90_99").otherwise("top_1")
    return M.segment_report(v, seg).select("segment", r("mae", 3).alias("mae"), r("bias", 3).alias("bias"), "n")


ZB = "(SELECT quantile_cont(y, 0.85) AS y85, quantile_cont(y, 0.95) AS y95 FROM pp)"


@query("r16_zone_contribution", sql(f"SELECT CASE WHEN y < y85 THEN 'base' WHEN y < y95 THEN 'boundary' ELSE 'tail' END AS zone, CAST(count(*) AS BIGINT) AS n, {sr('avg(er)', 3)} AS mae, {sr('sum(er) / any_value(tot) * 100', 5)} AS contribution_pct, {sr('avg(((p >= 0.3) <> tail)::INT)')} AS class_error FROM (SELECT *, abs(y - CASE WHEN p >= 0.3 THEN t ELSE nt END) AS er, sum(abs(y - CASE WHEN p >= 0.3 THEN t ELSE nt END)) OVER () AS tot FROM tl), {ZB} GROUP BY 1"))
def r16(spark, sf_dir):
    t = tailed(spark, sf_dir)
    a, b = q(t, "y", 0.85, 0.95)
    er = F.abs(c_y() - F.when(c_p() >= 0.3, c_t()).otherwise(c_nt()))
    zone = F.when(c_y() < a, "base").when(c_y() < b, "boundary").otherwise("tail")
    per = t.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.avg(er).alias("mae"), F.sum(er).alias("s"), F.avg(((c_p() >= 0.3) != F.col("tail")).cast("double")).alias("ce"))
    share = F.col("s") / F.sum("s").over(W.partitionBy(F.lit(0))) * 100  # three rows
    return per.select("zone", "n", r("mae", 3).alias("mae"), r(share, 5).alias("contribution_pct"), r("ce").alias("class_error"))


@query("r17_scenario_dynamics", sql(f"SELECT sid, {sr('stddev_samp(y)', 3)} AS target_std, {sr('stddev_samp(oof)', 3)} AS pred_std, {sr('stddev_samp(oof) / (stddev_samp(y) + 1e-6)', 5)} AS ratio FROM vp GROUP BY 1"))
def r17(spark, sf_dir):
    v = preds(spark, sf_dir).where("has_oof")
    return v.groupBy("sid").agg(r(F.stddev_samp("y"), 3).alias("target_std"), r(F.stddev_samp("oof"), 3).alias("pred_std"), r(F.stddev_samp("oof") / (F.stddev_samp("y") + 1e-6), 5).alias("ratio"))


@query("r18_auc_per_scenario", sql(f"SELECT sid, {sr('auc')} AS auc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM {auc_sql('p', 'tail', 'tl', 'sid')} WHERE auc IS NOT NULL"))
def r18(spark, sf_dir):
    return ranks.roc_auc(tailed(spark, sf_dir), ["sid"], "p", F.col("tail")).where("auc IS NOT NULL").select("sid", r("auc").alias("auc"), "n_pos", "n_neg")


@query("r18_auc_spread", sql(f"SELECT {sr('max(auc)')} AS best, {sr('min(auc)')} AS worst, {sr('var_pop(auc)')} AS variance FROM {auc_sql('p', 'tail', 'tl', 'sid')} WHERE auc IS NOT NULL"))
def r18b(spark, sf_dir):
    a = ranks.roc_auc(tailed(spark, sf_dir), ["sid"], "p", F.col("tail"))
    return a.agg(r(F.max("auc")).alias("best"), r(F.min("auc")).alias("worst"), r(F.var_pop("auc")).alias("variance"))


GAIN_SQL = "gn AS (SELECT *, abs(y - nt) - abs(y - t) AS gain FROM tl)"


@query("r19_gain_distribution", sql(f"SELECT {sr('avg((gain > 0)::INT)')} AS positive_share, {sr('avg(gain)', 3)} AS mean_gain, {sr('max(gain)', 3)} AS max_gain, {sr('min(gain)', 3)} AS min_gain, {sr('quantile_cont(gain, 0.95)', 3)} AS p95_gain, {sr('quantile_cont(gain, 0.99)', 3)} AS p99_gain, {sr('corr(p, gain)')} AS corr_p_gain, {sr('corr(p, abs(gain))')} AS corr_p_abs_gain FROM gn", GAIN_SQL))
def r19(spark, sf_dir):
    g = preds(spark, sf_dir).withColumn("gain", c_gain())
    p95, p99 = q(g, "gain", 0.95, 0.99)
    m = g.agg(r(F.avg((F.col("gain") > 0).cast("double"))).alias("positive_share"), r(F.avg("gain"), 3).alias("mean_gain"), r(F.max("gain"), 3).alias("max_gain"), r(F.min("gain"), 3).alias("min_gain"), r(X.corr("p", "gain")).alias("corr_p_gain"), r(X.corr(c_p(), F.abs("gain"))).alias("corr_p_abs_gain"))
    return m.select("*", r(F.lit(p95), 3).alias("p95_gain"), r(F.lit(p99), 3).alias("p99_gain"))


@query("r19_gain_by_p_bin", sql(f"SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS p_bin, {sr('avg(gain)', 3)} AS mean_gain, CAST(count(*) AS BIGINT) AS n FROM gn GROUP BY 1", GAIN_SQL))
def r19b(spark, sf_dir):
    return preds(spark, sf_dir).groupBy(F.least(F.floor(c_p() * 5), F.lit(4)).cast("int").alias("p_bin")).agg(r(F.avg(c_gain()), 3).alias("mean_gain"), F.count(F.lit(1)).alias("n"))


CASES = {"A": "p > 0.65", "B": "t > nt * 2.0 AND p > 0.4", "OR": "p > 0.65 OR (t > nt * 2.0 AND p > 0.4)"}


@query("r20_gate_case_map", sql(" UNION ALL ".join(f"SELECT '{n}' AS method, CAST(count_if({c}) AS BIGINT) AS n_pass, CAST(count_if(tail AND ({c})) AS BIGINT) AS n_tp, CAST(count_if(NOT tail AND ({c})) AS BIGINT) AS n_fp, {sr(f'count_if(tail AND ({c})) / (count_if({c}) + 1e-9)')} AS precision, {sr(f'avg(w) FILTER ({c})')} AS mean_weight FROM tl" for n, c in CASES.items())))
def r20(spark, sf_dir):
    tail = F.col("tail")
    m = M.policy_table(
        tailed(spark, sf_dir), {n: F.expr(c) for n, c in CASES.items()}, n_pass=F.count_if, n_tp=lambda c: F.count_if(tail & c), n_fp=lambda c: F.count_if(~tail & c), precision=lambda c: F.count_if(tail & c) / (F.count_if(c) + 1e-9), mean_weight=lambda c: F.avg(F.when(c, c_w()))
    )
    return m.select("method", "n_pass", "n_tp", "n_fp", r("precision").alias("precision"), r("mean_weight").alias("mean_weight"))


@query("r21_controller_stats", sql(f"SELECT {sr('avg((d < 0.99)::INT) * 100', 4)} AS activation_pct, {sr('coalesce(avg(d) FILTER (d < 0.99), 1.0)')} AS mean_damping, {sr('avg((gap > 3.0)::INT) * 100', 4)} AS high_risk_pct, {sr('avg(gap)')} AS mean_gap FROM (SELECT gap, w / (1.0 / (1.0 + exp(-8.0 * (p - 0.55))) + 1e-9) AS d FROM tl)"))
def r21(spark, sf_dir):
    d = F.col("d")
    s = preds(spark, sf_dir).select("gap", (c_w() / (X.sigmoid_gate(c_p()) + 1e-9)).alias("d"))
    return s.agg(r(F.avg((d < 0.99).cast("double")) * 100, 4).alias("activation_pct"), r(F.coalesce(F.avg(F.when(d < 0.99, d)), F.lit(1.0))).alias("mean_damping"), r(F.avg((F.col("gap") > 3.0).cast("double")) * 100, 4).alias("high_risk_pct"), r(F.avg("gap")).alias("mean_gap"))


@query("r22_deep_false_positives", with_sql(ORDERS_SQL + "," + PRED_SQL, f"""SELECT CAST(count_if(fp) AS BIGINT) AS n_fp, CAST(count_if(fp AND y < 0.3 * q90) AS BIGINT) AS n_deep, CAST(count_if(fp AND y >= 0.7 * q90) AS BIGINT) AS n_boundary, {sr('avg(qty_sum) FILTER (fp AND y < 0.3 * q90)')} AS deep_qty, {sr('avg(qty_sum) FILTER (tail AND w > 0.3)')} AS tp_qty
 FROM (SELECT tl.*, qty_sum, NOT tail AND w > 0.3 AS fp FROM tl JOIN op USING (id)), (SELECT quantile_cont(y, 0.9) AS q90 FROM pp)""", TAIL_SQL))
def r22(spark, sf_dir):
    t = tailed(spark, sf_dir)
    q90 = q(t, "y", 0.9)[0]
    rows = t.select("id", "y", "tail", "w").join(S.order_panel(spark, sf_dir).select("id", "qty_sum"), "id")
    fp = ~F.col("tail") & (c_w() > 0.3)
    deep = fp & (c_y() < 0.3 * q90)
    return rows.agg(F.count_if(fp).alias("n_fp"), F.count_if(deep).alias("n_deep"), F.count_if(fp & (c_y() >= 0.7 * q90)).alias("n_boundary"), r(F.avg(F.when(deep, F.col("qty_sum")))).alias("deep_qty"), r(F.avg(F.when(F.col("tail") & (c_w() > 0.3), F.col("qty_sum")))).alias("tp_qty"))


RUN_SQL = "rn AS (SELECT CAST(id % 25 AS INTEGER) AS run, avg(e) FILTER (fold < 2) AS proxy, avg(e) FILTER (fold >= 2) AS lb, avg(abs(y - nt)) AS oo FROM vp GROUP BY 1)"


def runs(spark, sf_dir):
    """25 runs, each with a proxy, a leaderboard and an out-of-fold error."""
    v = preds(spark, sf_dir).where("has_oof")
    return v.groupBy((F.col("id") % 25).cast("int").alias("run")).agg(F.avg(F.when(F.col("fold") < 2, c_err())).alias("proxy"), F.avg(F.when(F.col("fold") >= 2, c_err())).alias("lb"), F.avg(F.abs(c_y() - c_nt())).alias("oo"))


@query("r23_proxy_leaderboard_correlation", sql(f"""SELECT {sr('a')} AS pearson_proxy, {sr('c')} AS pearson_oof, {sr('b')} AS spearman_proxy, {sr('g', 2)} AS mean_gap, CASE WHEN a > c + 0.1 THEN 'PROXY_SUPERIOR' WHEN a > c THEN 'PROXY_MARGINAL' ELSE 'PROXY_NO_IMPROVEMENT' END AS verdict FROM
 (SELECT corr(proxy, lb) AS a, corr(oo, lb) AS c, corr(rp, rl) AS b, avg(abs(proxy - lb)) AS g FROM (SELECT *, rank() OVER (ORDER BY proxy) * 1.0 AS rp, rank() OVER (ORDER BY lb) * 1.0 AS rl FROM rn WHERE proxy IS NOT NULL AND lb IS NOT NULL))""", RUN_SQL))
def r23(spark, sf_dir):
    rr = runs(spark, sf_dir).where("proxy IS NOT NULL AND lb IS NOT NULL")
    rho = spearman(rr, [], "proxy", "lb").select("rho").scalar()
    m = rr.agg(X.corr("proxy", "lb").alias("a"), X.corr("oo", "lb").alias("c"), F.avg(F.abs(F.col("proxy") - F.col("lb"))).alias("g"))
    verdict = F.when(F.col("a") > F.col("c") + 0.1, "PROXY_SUPERIOR").when(F.col("a") > F.col("c"), "PROXY_MARGINAL").otherwise("PROXY_NO_IMPROVEMENT")
    return m.select(r("a").alias("pearson_proxy"), r("c").alias("pearson_oof"), r(rho).alias("spearman_proxy"), r("g", 2).alias("mean_gap"), verdict.alias("verdict"))


def reality(df, cols):
    """(feature, null share, variance, extreme count) for the audit rules."""
    return drift.stats_long(df, cols, nulls=lambda c: F.avg(c.isNull().cast("double")), var=F.var_samp, extreme=lambda c: F.count_if(F.abs(c) > 1e6))


@query("r26_reality_audit", with_sql(ORDERS_SQL, f"""SELECT CAST(count_if(nl > 0.05) AS BIGINT) AS high_nan, CAST(count_if(vr = 0) AS BIGINT) AS zero_var, CAST(count_if(vr < 1e-4) AS BIGINT) AS low_var, CAST(count_if(ex > 0) AS BIGINT) AS extreme,
 (SELECT CAST(count(DISTINCT f) AS BIGINT) FROM (SELECT unnest([feature_a, feature_b]) AS f FROM ({corr_pairs_sql(S.SENSORS, 'fl')}) WHERE abs(corr) > 0.98)) AS correlated, count_if(vr = 0) > 0 OR count_if(nl > 0.05) > 0 OR count_if(ex > 0) > 0 AS fails
 FROM ({' UNION ALL '.join(f"SELECT avg(({c} IS NULL)::INT) AS nl, var_samp({c}) AS vr, count_if(abs({c}) > 1e6) AS ex FROM op" for c in S.SENSORS)})""", CORR_SQL))
def r26(spark, sf_dir):
    a = reality(S.order_panel(spark, sf_dir), S.SENSORS)
    pairs = TB.correlation_pairs(filled(spark, sf_dir), S.SENSORS).where(F.abs("corr") > 0.98)
    both = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("f")).agg(F.count_distinct("f").alias("n")).scalar()
    m = a.agg(F.count_if(F.col("nulls") > 0.05).alias("high_nan"), F.count_if(F.col("var") == 0).alias("zero_var"), F.count_if(F.col("var") < 1e-4).alias("low_var"), F.count_if(F.col("extreme") > 0).alias("extreme"))
    return m.withColumn("correlated", both).withColumn("fails", (F.col("zero_var") > 0) | (F.col("high_nan") > 0) | (F.col("extreme") > 0))


@query("r27_go_no_go", sql(f"""SELECT {sr('avg(s)', 2)} AS mean_mae, {sr('stddev_samp(s)', 2)} AS std_mae, {sr('avg(s) - avg(o)', 2)} AS gap, CASE WHEN avg(s) <= 100000 AND avg(s) - avg(o) <= 5000 AND stddev_samp(s) <= 5000 THEN 'HIGH' WHEN avg(s) < 200000 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT fold, avg(e) AS s, avg(b) AS o FROM vp GROUP BY 1)"""))
def r27(spark, sf_dir):
    per = preds(spark, sf_dir).where("has_oof").groupBy("fold").agg(F.avg(c_err()).alias("s"), F.avg(F.abs(c_y() - c_nt())).alias("o"))
    m = per.agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"), (F.avg("s") - F.avg("o")).alias("g"))
    go = (F.col("m") <= 100000) & (F.col("g") <= 5000) & (F.col("sd") <= 5000)
    return m.select(r("m", 2).alias("mean_mae"), r("sd", 2).alias("std_mae"), r("g", 2).alias("gap"), F.when(go, "HIGH").when(F.col("m") < 200000, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("r28_oof_vs_test", sql(f"SELECT {sr('avg(e)', 3)} AS oof_mae, {sr('avg(oof)', 3)} AS oof_mean, {sr('stddev_pop(oof)', 3)} AS oof_std, {sr('(SELECT stddev_pop(nt) FROM tl WHERE oof IS NULL) / (stddev_pop(oof) + 1e-9)')} AS std_ratio, CASE WHEN (SELECT stddev_pop(nt) FROM tl WHERE oof IS NULL) / (stddev_pop(oof) + 1e-9) < 0.6 THEN 'COLLAPSED' WHEN (SELECT stddev_pop(nt) FROM tl WHERE oof IS NULL) / (stddev_pop(oof) + 1e-9) > 1.4 THEN 'EXPLODED' ELSE 'STABLE' END AS status FROM vp"))
def r28(spark, sf_dir):
    m = preds(spark, sf_dir).agg(F.avg(c_err()).alias("mae"), F.avg("oof").alias("om"), F.stddev_pop("oof").alias("os"), F.stddev_pop(F.when(c_oof().isNull(), c_nt())).alias("ts"))
    ratio = F.col("ts") / (F.col("os") + 1e-9)
    return m.select(r("mae", 3).alias("oof_mae"), r("om", 3).alias("oof_mean"), r("os", 3).alias("oof_std"), r(ratio).alias("std_ratio"), F.when(ratio < 0.6, "COLLAPSED").when(ratio > 1.4, "EXPLODED").otherwise("STABLE").alias("status"))


@query("r29_feature_set_contract", with_sql(ORDERS_SQL, f"""SELECT CAST(count_if(sd < 1e-4) AS BIGINT) AS low_std, CAST(sum(nn) AS BIGINT) AS n_null, (SELECT CAST(count(*) AS BIGINT) FROM ({corr_pairs_sql(S.SENSORS[:4], 'fl')}) WHERE abs(corr) > 0.98) AS collinear, true AS disjoint FROM ({' UNION ALL '.join(f"SELECT stddev_samp({c}) AS sd, count_if({c} IS NULL) AS nn FROM op" for c in S.SENSORS[:4])})""", CORR_SQL))
def r29(spark, sf_dir):
    group_a, group_b = S.SENSORS[:4], S.SENSORS[4:]
    s = drift.stats_long(S.order_panel(spark, sf_dir), group_a, sd=F.stddev_samp, nn=lambda c: F.count_if(c.isNull()))
    collinear = TB.correlation_pairs(filled(spark, sf_dir), group_a).agg(F.count_if(F.abs("corr") > 0.98).alias("n")).scalar()
    return s.agg(F.count_if(F.col("sd") < 1e-4).alias("low_std"), F.sum("nn").alias("n_null")).withColumn("collinear", collinear).withColumn("disjoint", F.lit(not set(group_a) & set(group_b)))


@query("r30_fold_consistency", sql(f"SELECT {sr('stddev_pop(g)')} AS gain_ratio_std, {sr('stddev_pop(m)', 3)} AS mae_std, {sr('avg(m)', 3)} AS mae_mean FROM (SELECT fold, avg((gain > 0)::INT) AS g, avg(abs(y - oof)) AS m FROM gn GROUP BY 1)", GAIN_SQL))
def r30(spark, sf_dir):
    per = preds(spark, sf_dir).groupBy("fold").agg(F.avg((c_gain() > 0).cast("double")).alias("g"), F.avg(c_err()).alias("m"))
    return per.agg(r(F.stddev_pop("g")).alias("gain_ratio_std"), r(F.stddev_pop("m"), 3).alias("mae_std"), r(F.avg("m"), 3).alias("mae_mean"))


@query("r31_tail_recovery_per_fold", sql(f"SELECT fold, {sr('avg(oof) / avg(y)')} AS recovery, CAST(count(*) AS BIGINT) AS tail_count FROM vp WHERE tail GROUP BY 1"))
def r31(spark, sf_dir):
    return valid(spark, sf_dir).where("tail").groupBy("fold").agg(r(F.avg("oof") / F.avg("y")).alias("recovery"), F.count(F.lit(1)).alias("tail_count"))


@query("r31_tail_recovery_per_threshold", sql(" UNION ALL ".join(f"SELECT 'Q{int(x * 100)}' AS method, {sr('avg(oof) / avg(y)')} AS recovery FROM vp WHERE y >= (SELECT quantile_cont(y, {x}) FROM pp)" for x in (0.85, 0.9, 0.95))))
def r31b(spark, sf_dir):
    pp = preds(spark, sf_dir)
    cuts = dict(zip(("Q85", "Q90", "Q95"), q(pp, "y", 0.85, 0.9, 0.95)))
    m = M.policy_table(pp.where("has_oof"), {n: c_y() >= c for n, c in cuts.items()}, recovery=lambda c: F.avg(F.when(c, c_oof())) / F.avg(F.when(c, c_y())))
    return m.select("method", r("recovery").alias("recovery"))


@query("r32_scenario_precision", sql(f"SELECT {sr('avg(pr)')} AS mean_precision, {sr('avg((pr = 0)::INT)')} AS zero_share, CAST(count(*) AS BIGINT) AS n FROM (SELECT sid, CASE WHEN count_if(p >= c) > 0 THEN count_if(tail AND p >= c) * 1.0 / count_if(p >= c) ELSE 0 END AS pr FROM tl, (SELECT quantile_cont(p, 0.9) AS c FROM pp) GROUP BY 1 HAVING count_if(tail) > 0)"))
def r32(spark, sf_dir):
    t = tailed(spark, sf_dir)
    c = c_p() >= q(t, "p", 0.9)[0]
    per = t.groupBy("sid").agg(F.coalesce(F.try_divide(F.count_if(F.col("tail") & c), F.count_if(c)), F.lit(0.0)).alias("pr"), F.count_if("tail").alias("k")).where("k > 0")
    return per.agg(r(F.avg("pr")).alias("mean_precision"), r(F.avg((F.col("pr") == 0).cast("double"))).alias("zero_share"), F.count(F.lit(1)).alias("n"))


@query("r33_class_expectations", sql(f"SELECT {sr('avg(p) FILTER (tail)')} AS p_tail, {sr('avg(p) FILTER (NOT tail)')} AS p_bulk, {sr('avg(abs(y - (p * t + (1 - p) * nt)))', 3)} AS mae, {sr('avg(abs(y - (p * t + (1 - p) * nt))) FILTER (tail)', 3)} AS mae_tail, {sr('avg(abs(y - (p * t + (1 - p) * nt))) FILTER (NOT tail)', 3)} AS mae_bulk FROM tl"))
def r33(spark, sf_dir):
    tail, e = F.col("tail"), F.abs(c_y() - X.blend(c_p(), c_t(), c_nt()))
    return tailed(spark, sf_dir).agg(r(F.avg(F.when(tail, c_p()))).alias("p_tail"), r(F.avg(F.when(~tail, c_p()))).alias("p_bulk"), r(F.avg(e), 3).alias("mae"), r(F.avg(F.when(tail, e)), 3).alias("mae_tail"), r(F.avg(F.when(~tail, e)), 3).alias("mae_bulk"))


@query("r34_blend_fp_fn", sql(f"SELECT {sr('avg((NOT tail AND f > nt)::INT)')} AS fp_rate, {sr('avg((tail AND f <= nt)::INT)')} AS fn_rate, {sr('coalesce(sum(abs(f - y)) FILTER (NOT tail AND f > nt), 0) / count(*)', 3)} AS fp_damage, {sr('coalesce(sum(abs(f - y)) FILTER (p >= 0.2 AND p <= 0.4), 0) / count(*)', 3)} AS boundary_contribution FROM (SELECT *, nt + p * p * (t - nt) AS f FROM tl)"))
def r34(spark, sf_dir):
    f, tail = c_nt() + c_p() * c_p() * (c_t() - c_nt()), F.col("tail")
    fp = ~tail & (f > c_nt())
    n = F.count(F.lit(1))
    share = lambda c: F.coalesce(F.sum(F.when(c, F.abs(f - c_y()))), F.lit(0.0)) / n
    return tailed(spark, sf_dir).agg(r(F.avg(fp.cast("double"))).alias("fp_rate"), r(F.avg((tail & (f <= c_nt())).cast("double"))).alias("fn_rate"), r(share(fp), 3).alias("fp_damage"), r(share(c_p().between(0.2, 0.4)), 3).alias("boundary_contribution"))


DC_SQL = "dc AS (SELECT *, t - nt AS d, least(greatest(t - nt, -md), md) AS c FROM tl, (SELECT quantile_cont(abs(y - nt), 0.95) AS md FROM tl WHERE NOT tail))"


@query("r35_clip_side_effect", sql(f"SELECT {sr('(avg(d) FILTER (tail) - avg(c) FILTER (tail)) / (avg(d) FILTER (tail) + 1e-9)')} AS tail_loss, {sr('(avg(d) FILTER (NOT tail AND p > 0.1) - avg(c) FILTER (NOT tail AND p > 0.1)) / (avg(d) FILTER (NOT tail AND p > 0.1) + 1e-9)')} AS fp_reduction FROM dc", DC_SQL))
def r35(spark, sf_dir):
    t = tailed(spark, sf_dir)
    md = q(t.where("NOT tail").select(F.abs(c_y() - c_nt()).alias("e")), "e", 0.95)[0]
    d = c_t() - c_nt()
    c = X.clip(d, -md, md)
    rel = lambda m: (F.avg(F.when(m, d)) - F.avg(F.when(m, c))) / (F.avg(F.when(m, d)) + 1e-9)
    return t.agg(r(rel(F.col("tail"))).alias("tail_loss"), r(rel(~F.col("tail") & (c_p() > 0.1))).alias("fp_reduction"))


@query("r38_log_transform_bias", sql(f"SELECT {sr('(exp(avg(ln(1 + y))) - 1) / avg(y)')} AS transform_bias, {sr('avg(oof) / avg(y)')} AS observed_bias FROM vp"))
def r38(spark, sf_dir):
    return preds(spark, sf_dir).where("has_oof").agg(r(F.expm1(F.avg(F.log1p("y"))) / F.avg("y")).alias("transform_bias"), r(F.avg("oof") / F.avg("y")).alias("observed_bias"))


@query("r39_row_order_segments", sql(f"SELECT CAST(least(pos // (n // 10), 9) AS INTEGER) AS segment, CAST(count(*) AS BIGINT) AS n, {sr('avg(e)', 3)} AS mae FROM (SELECT e, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM vp) GROUP BY 1"))
def r39(spark, sf_dir):
    v = preds(spark, sf_dir).where("has_oof").select("id", c_err().alias("e"))
    n = v.agg(F.count(F.lit(1)).alias("n")).scalar()
    seg = F.least(F.floor(F.col("pos") / F.floor(n / 10)), F.lit(9)).cast("int")
    return row_positions(v, [], ["id"]).groupBy(seg.alias("segment")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("e"), 3).alias("mae"))
