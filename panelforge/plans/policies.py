"""Blend, weight, calibration and sweep queries on given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators import metrics as M, policies as PO, ranks
from panelforge.operators.quantiles import fit_quantiles
from panelforge.operators.sets import set_overlap
from panelforge.plans.aggregates import RANK_SQL, TAIL_SQL, q, tailed
from panelforge.plans.registry import PRED_SQL, query, r, sr, with_sql
from panelforge.plans.reports import DC_SQL, c_err, c_gain, GAIN_SQL, c_nt, c_oof, c_p, c_t, c_y, preds, sql


@query("m4_oof_assembly", with_sql(PRED_SQL, f"SELECT id, {sr('g0')} AS gap, {sr('wt')} AS weight, {sr('wt * t + (1 - wt) * nt', 3)} AS blended, nt AS base FROM (SELECT *, w0 * least(greatest(1.0 - least(greatest((g0 - 3.0) / 3.0, 0.0), 2.0) * least(greatest((0.7 - p) / 0.7, 0.0), 1.0) * 0.5, 0.5), 1.0) AS wt FROM pr1)"))
def m4(spark, sf_dir):
    a = PO.assemble(preds(spark, sf_dir).select("id", "p", "t", "nt"))
    return a.select("id", r("gap").alias("gap"), r("weight").alias("weight"), r("blended", 3).alias("blended"), F.col("nt").alias("base"))


@query("m5_fold_ensemble", "SELECT l_orderkey AS id, " + sr("avg(l_extendedprice * (1 - l_discount))", 3) + " AS pred, CAST(count(*) AS BIGINT) AS n_folds FROM lineitem GROUP BY 1")
def m5(spark, sf_dir):
    from panelforge.sources import panels as S

    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred"))
    return PO.fold_ensemble(li, "id", "pred").select("id", r("pred", 3).alias("pred"), "n_folds")


@query("m8_adversarial_weights", with_sql(PRED_SQL, f"SELECT id, {sr('b / (1 - b) / (avg(b / (1 - b)) OVER ())')} AS weight FROM (SELECT id, least(p, 1 - 1e-6) AS b FROM pp)"))
def m8(spark, sf_dir):
    return PO.adversarial_weights(preds(spark, sf_dir).select("id", "p"), "p").select("id", r("weight").alias("weight"))


@query("m9_target_aware_weights", with_sql(PRED_SQL, f"SELECT id, {sr('least(greatest(CASE WHEN y > p90 THEN 1.0 + 0.5 * (y - p90) / (sd + 1e-6) ELSE 1.0 END, 1.0), 5.0)')} AS weight FROM pp, (SELECT quantile_cont(y, 0.9) AS p90, stddev_pop(y) AS sd FROM pp)"))
def m9(spark, sf_dir):
    return PO.tail_weights(preds(spark, sf_dir).select("id", "y"), "y").select("id", r("weight").alias("weight"))


CALIB_SQL = "cb AS (SELECT avg(oof) AS pm, avg(y) AS tm, least(1.5, stddev_pop(y) / (stddev_pop(oof) + 1e-9)) AS k FROM vp)"


@query("m11_variance_mean_calibration", sql(f"SELECT id, {sr('(coalesce(oof, nt) - pm) * k + tm', 3)} AS stable FROM pp, cb", CALIB_SQL))
def m11(spark, sf_dir):
    pp = preds(spark, sf_dir)
    state = PO.fit_calibration(pp, "y", "oof")
    return pp.select("id", r(PO.calibrate(F.coalesce("oof", "nt"), state), 3).alias("stable"))


# The search space of the blend parameters.
SPACE = {"th_scale": [0.8, 0.9, 1.0, 1.1, 1.2], "temp_scale": [0.5, 0.75, 1.0, 1.5, 2.0], "ext_penalty": [0.7, 0.8, 0.85, 0.9, 0.95, 1.0], "cat_weight": [0.2, 0.3, 0.4, 0.5, 0.6]}
CONFIGS = [
    {"th_scale": SPACE["th_scale"][i % 5], "temp_scale": SPACE["temp_scale"][(i // 5) % 5], "ext_penalty": SPACE["ext_penalty"][(i * 7) % 6], "cat_weight": SPACE["cat_weight"][(i * 3 + i // 5) % 5]}
    for i in range(50)
]


def search_results(spark, sf_dir):
    """(config parameters, mae, mean, p99, std, score) of every configuration, from one pass plus one quantile pass."""
    pp = preds(spark, sf_dir)
    stats = fit_quantiles(pp, {"p": (c_p(), [0.5]), "y": (c_y(), [0.99])})
    base_th, y99 = stats["p"][0], stats["y"][0]
    m = pp.agg(F.stddev_pop("p").alias("s"), F.avg("y").alias("m")).first()
    test, oof = ~F.col("has_oof"), F.col("has_oof")
    made = []
    for c in CONFIGS:
        theta, temp = base_th * c["th_scale"], (m.s + 1e-6) * c["temp_scale"]
        made.append((PO.regime_blend(c_p(), c_t(), c_nt(), theta, temp, c["cat_weight"]), PO.regime_blend(c_p(), c_t(), c_nt(), theta, temp, c["cat_weight"], c["ext_penalty"])))
    p99 = fit_quantiles(pp.where(test), {f"c{i}": (b, [0.99]) for i, (_, b) in enumerate(made)})
    wide = pp.agg(*[x for i, (a, b) in enumerate(made) for x in (F.avg(F.when(oof, F.abs(a - c_y()))).alias(f"a{i}"), F.avg(F.when(test, b)).alias(f"m{i}"), F.stddev_pop(F.when(test, b)).alias(f"s{i}"))])
    cells = [
        F.struct(F.lit(i).alias("config"), *[F.lit(v).alias(k) for k, v in c.items()], F.col(f"a{i}").alias("mae"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.lit(p99[f"c{i}"][0]).alias("p99"))
        for i, c in enumerate(CONFIGS)
    ]
    score = F.col("mae") + 0.1 * F.abs(F.col("mean") - F.lit(m.m)) + 0.05 * F.abs(F.col("p99") - F.lit(y99))
    return wide.select(F.inline(F.array(*cells))).withColumn("score", score)


SEARCH_SQL = (
    "cf(config, th_scale, temp_scale, ext_penalty, cat_weight) AS (VALUES " + ", ".join(f"({i}, {c['th_scale']}::DOUBLE, {c['temp_scale']}::DOUBLE, {c['ext_penalty']}::DOUBLE, {c['cat_weight']}::DOUBLE)" for i, c in enumerate(CONFIGS)) + ")",
    "gs AS (SELECT quantile_cont(p, 0.5) AS th, stddev_pop(p) + 1e-6 AS tp, avg(y) AS ym, quantile_cont(y, 0.99) AS y99 FROM pp)",
    "sm AS (SELECT cf.*, oof, y, ym, y99, 1.0 / (1.0 + exp(-(p - th * th_scale) / (tp * temp_scale))) AS sh, cat_weight * t + (1 - cat_weight) * nt AS mx, nt FROM pp, gs, cf)",
    """se AS (SELECT config, any_value(th_scale) AS th_scale, any_value(temp_scale) AS temp_scale, any_value(ext_penalty) AS ext_penalty, any_value(cat_weight) AS cat_weight, avg(abs(sh * mx + (1 - sh) * nt - y)) FILTER (oof IS NOT NULL) AS mae,
 avg(sh * mx * ext_penalty + (1 - sh) * nt) FILTER (oof IS NULL) AS mean, quantile_cont(sh * mx * ext_penalty + (1 - sh) * nt, 0.99) FILTER (oof IS NULL) AS p99, any_value(ym) AS ym, any_value(y99) AS y99 FROM sm GROUP BY 1)""",
    "sx AS (SELECT *, mae + 0.1 * abs(mean - ym) + 0.05 * abs(p99 - y99) AS score FROM se)",
)


@query("m16_blend_search", with_sql(PRED_SQL, f"SELECT CAST(config AS INTEGER) AS config, th_scale, temp_scale, ext_penalty, cat_weight, {sr('mae', 2)} AS mae, {sr('mean', 2)} AS mean, {sr('p99', 2)} AS p99, {sr('score', 2)} AS score FROM sx", *SEARCH_SQL))
def m16(spark, sf_dir):
    return search_results(spark, sf_dir).select("config", *SPACE, *[r(c, 2).alias(c) for c in ("mae", "mean", "p99", "score")])


@query("m16_parameter_sensitivity", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT '{c}' AS parameter, {sr(f'corr({c}, score)', 5)} AS correlation FROM sx" for c in SPACE), *SEARCH_SQL))
def m16b(spark, sf_dir):
    wide = search_results(spark, sf_dir).agg(*[X.corr(c, "score").alias(c) for c in SPACE])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("parameter"), r(c, 5).alias("correlation")) for c in SPACE])))


POWERS = (1, 1.5, 2, 3, 5, 7, 10)


@query("m17_damping_power_sweep", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT {n}::DOUBLE AS power, {sr(f'avg(abs(y - (pow(p, {n}) * t + (1 - pow(p, {n})) * nt)))', 3)} AS mae, {sr(f'avg(abs(y - nt)) - avg(abs(y - (pow(p, {n}) * t + (1 - pow(p, {n})) * nt)))', 3)} AS improvement FROM pp" for n in POWERS)))
def m17(spark, sf_dir):
    m = M.policy_table(preds(spark, sf_dir), {str(float(n)): PO.damped(c_p(), c_t(), c_nt(), n) for n in POWERS}, mae=lambda c: F.avg(F.abs(c_y() - c)), base=lambda c: F.avg(F.abs(c_y() - c_nt())))
    return m.select(F.col("method").cast("double").alias("power"), r("mae", 3).alias("mae"), r(F.col("base") - F.col("mae"), 3).alias("improvement"))


@query("a13_threshold_power_pivot", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, " + ", ".join(f"{sr(f'avg(abs(y - CASE WHEN p >= {t} THEN pow(p, {n}) * t + (1 - pow(p, {n})) * nt ELSE nt END))', 3)} AS power_{n}" for n in (1, 2, 5)) + " FROM pp" for t in (0.1, 0.2, 0.3, 0.5))))
def a13(spark, sf_dir):
    grid = {f"{t}|{n}": PO.damped(c_p(), c_t(), c_nt(), n, t) for t in (0.1, 0.2, 0.3, 0.5) for n in (1, 2, 5)}
    long = M.policy_table(preds(spark, sf_dir), grid, mae=lambda c: F.avg(F.abs(c_y() - c)))
    parts = F.split("method", r"\|")
    cells = long.select(parts[0].cast("double").alias("threshold"), parts[1].alias("power"), "mae")
    pivot = cells.groupBy("threshold").pivot("power", ["1", "2", "5"]).agg(F.first("mae"))
    return pivot.select("threshold", *[r(F.col(str(n)), 3).alias(f"power_{n}") for n in (1, 2, 5)])


POLICY_SQL = {
    "expected_value": "p * t + (1 - p) * nt", "risk_adjusted": "nt + p * p * d", "meta_gate": "CASE WHEN p > 0.4 THEN t ELSE nt END", "sharpening": "nt + pow(1 / (1 + exp(-10 * (p - 0.3))), 2) * d",
    "soft_top_k": "nt + pow(ra, 5) * d", "conditional_clip": "nt + p * p * CASE WHEN p < 0.4 THEN c ELSE d END", "asymmetric_clip": "nt + p * p * CASE WHEN d > 0 THEN least(d, md) ELSE d END",
    "z_normalised": "nt + least(greatest((p - pm) / (ps + 1e-9), 0), 1) * d", "rank_weight": "nt + ra * d", "boundary_suppression": "CASE WHEN p >= 0.2 AND p <= 0.4 THEN nt ELSE nt + p * p * d END",
    "boundary_attenuation": "nt + CASE WHEN p >= 0.2 AND p <= 0.4 THEN 0.3 ELSE 1.0 END * p * p * d", "residual_clip": "nt + p * p * c",
}


@query("m18_policy_benchmark", sql(" UNION ALL ".join(f"SELECT '{n}' AS method, {sr(f'avg(abs(y - ({e})))', 3)} AS mae, {sr(f'avg((NOT tail AND ({e}) > nt)::INT)')} AS fp_rate, {sr(f'avg((tail AND ({e}) <= nt)::INT)')} AS fn_rate, {sr(f'coalesce(sum(abs(({e}) - y)) FILTER (NOT tail AND ({e}) > nt), 0) / (count_if(NOT tail AND ({e}) > nt) + 1e-9)', 2)} AS fp_cost FROM dx" for n, e in POLICY_SQL.items()), DC_SQL,
    "dx AS (SELECT *, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS ra, avg(p) OVER () AS pm, stddev_pop(p) OVER () AS ps FROM dc)"))
def m18(spark, sf_dir):
    t = ranks.percent_rank_ties(tailed(spark, sf_dir), [], "p", "ra")
    md = q(t.where("NOT tail").select(F.abs(c_y() - c_nt()).alias("e")), "e", 0.95)[0]
    m = t.agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s")).first()
    pols = PO.blend_policies(c_p(), F.col("ra"), c_t(), c_nt(), m.m, m.s, md)
    tail = F.col("tail")
    out = M.policy_table(
        t, pols, mae=lambda c: F.avg(F.abs(c_y() - c)), fp_rate=lambda c: F.avg((~tail & (c > c_nt())).cast("double")), fn_rate=lambda c: F.avg((tail & (c <= c_nt())).cast("double")),
        fp_cost=lambda c: F.coalesce(F.sum(F.when(~tail & (c > c_nt()), F.abs(c - c_y()))), F.lit(0.0)) / (F.count_if(~tail & (c > c_nt())) + 1e-9),
    )
    return out.select("method", r("mae", 3).alias("mae"), r("fp_rate").alias("fp_rate"), r("fn_rate").alias("fn_rate"), r("fp_cost", 2).alias("fp_cost"))


@query("m19_gain_labels", sql("SELECT id, gain > 0 AS tail_is_better, " + sr("gain", 3) + " AS gain FROM gn", GAIN_SQL))
def m19(spark, sf_dir):
    return preds(spark, sf_dir).select("id", (c_gain() > 0).alias("tail_is_better"), r(c_gain(), 3).alias("gain"))


ORACLE = {"no_tail": "nt", "full_tail": "t", "oracle": "CASE WHEN abs(y - nt) > abs(y - t) THEN t ELSE nt END", "label_oracle": "CASE WHEN tail THEN t ELSE nt END", "p_over_half": "CASE WHEN p > 0.5 THEN t ELSE nt END"}
PARTIAL = (0.01, 0.05, 0.1, 0.2, 0.5)


@query("m20_oracle_bound", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT '{n}' AS method, {sr(f'avg(abs(y - ({e})))', 3)} AS mae FROM rk" for n, e in ORACLE.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT 'partial_{k}' AS method, {sr(f'avg(abs(y - CASE WHEN CASE WHEN rp <= {k} THEN tail ELSE p >= 0.3 END THEN t ELSE nt END))', 3)} AS mae FROM rk" for k in PARTIAL), TAIL_SQL, RANK_SQL))
def m20(spark, sf_dir):
    from panelforge.plans.aggregates import ranked

    pols = {n: F.expr(e) for n, e in ORACLE.items()}
    pols |= {f"partial_{k}": F.when(F.when(F.col("rp") <= k, F.col("tail")).otherwise(c_p() >= 0.3), c_t()).otherwise(c_nt()) for k in PARTIAL}
    return M.policy_table(ranked(spark, sf_dir), pols, mae=lambda c: F.avg(F.abs(c_y() - c))).select("method", r("mae", 3).alias("mae"))


SHARES = (0.0, 0.05, 0.10, 0.20, 0.50)


@query("m22_fp_injection_sweep", sql(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS fp_ratio, {sr(f'avg(abs(y - CASE WHEN tail OR (id * 37) % 101 < {s} * 101 THEN t ELSE nt END))', 3)} AS mae FROM tl" for s in SHARES)))
def m22(spark, sf_dir):
    pols = {str(s): F.when(F.col("tail") | ((F.col("id") * 37) % 101 < s * 101), c_t()).otherwise(c_nt()) for s in SHARES}
    m = M.policy_table(tailed(spark, sf_dir), pols, mae=lambda c: F.avg(F.abs(c_y() - c)))
    return m.select(F.col("method").cast("double").alias("fp_ratio"), r("mae", 3).alias("mae"))


EV_SQL = "ez AS (SELECT *, CASE WHEN tail THEN abs(y - nt) - abs(y - t) ELSE 0 END AS g, CASE WHEN NOT tail THEN abs(t - y) - abs(nt - y) ELSE 0 END AS c FROM tl),\nev_ AS (SELECT *, round(p * g - (1 - p) * c, 6) AS ev, row_number() OVER (PARTITION BY fold ORDER BY round(p * g - (1 - p) * c, 6) DESC, id) AS rn FROM ez)"


def attack_zone(spark, sf_dir, size: int):
    t = tailed(spark, sf_dir)
    parts = PO.expected_value(F.col("tail"), c_y(), c_p(), c_t(), c_nt())
    t = t.select("id", "fold", "tail", "y", "p", *[c.alias(n) for n, c in parts.items()]).withColumn("ev", F.round("ev", 6))
    w = W.partitionBy("fold").orderBy(F.desc("ev"), "id")  # the rank limit runs map-side before the shuffle
    return t.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size)


@query("m27_attack_zone_value", sql(f"SELECT fold, CAST(size AS INTEGER) AS size, CAST(count_if(NOT tail) AS BIGINT) AS fp_count, {sr('avg(g)', 3)} AS mean_gain, {sr('avg(g) - avg(c)', 3)} AS expected_profit FROM ev_ JOIN (SELECT unnest([32, 50, 100]) AS size) ON rn <= size GROUP BY 1, 2", EV_SQL))
def m27(spark, sf_dir):
    top = attack_zone(spark, sf_dir, 100)
    sized = top.select("*", F.explode(F.filter(F.array(F.lit(32), F.lit(50), F.lit(100)), lambda s: s >= F.col("rn"))).alias("size"))
    return sized.groupBy("fold", "size").agg(F.count_if(~F.col("tail")).alias("fp_count"), r(F.avg("gain"), 3).alias("mean_gain"), r(F.avg("gain") - F.avg("cost"), 3).alias("expected_profit"))


@query("m27_zone_scenario_stability", sql(f"SELECT a.fold AS fold_a, b.fold AS fold_b, CAST(count_if(a.k = b.k) AS BIGINT) AS common, {sr('count_if(a.k = b.k) * 1.0 / (any_value(na) + any_value(nb) - count_if(a.k = b.k))')} AS jaccard FROM (SELECT *, count(*) OVER (PARTITION BY fold) AS na FROM zk) a JOIN (SELECT *, count(*) OVER (PARTITION BY fold) AS nb FROM zk) b ON a.fold < b.fold GROUP BY 1, 2", EV_SQL, "zk AS (SELECT DISTINCT fold, sid AS k FROM ev_ WHERE rn <= 100)"))
def m27b(spark, sf_dir):
    t = tailed(spark, sf_dir).select("id", "sid")
    zone = attack_zone(spark, sf_dir, 100).select("id", "fold")
    return set_overlap(t.join(zone, "id").select("fold", "sid").distinct(), "fold", "sid").withColumn("jaccard", r("jaccard"))


SWITCH = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


@query("m35_hard_switch_sweep", sql(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS threshold, {sr(f'avg(abs(y - CASE WHEN p >= {s} THEN t ELSE nt END))', 3)} AS mae, {sr(f'count_if(tail AND p >= {s}) * 1.0 / count_if(p >= {s})')} AS precision, {sr(f'count_if(tail AND p >= {s}) * 1.0 / count_if(tail)')} AS recall FROM tl" for s in SWITCH)))
def m35(spark, sf_dir):
    tail = F.col("tail")
    m = M.policy_table(
        tailed(spark, sf_dir), {str(s): c_p() >= s for s in SWITCH}, mae=lambda c: F.avg(F.abs(c_y() - F.when(c, c_t()).otherwise(c_nt()))), precision=lambda c: F.coalesce(F.try_divide(F.count_if(tail & c), F.count_if(c)), F.lit(0.0)), recall=lambda c: F.try_divide(F.count_if(tail & c), F.count_if(tail))
    )
    return m.select(F.col("method").cast("double").alias("threshold"), r("mae", 3).alias("mae"), r("precision").alias("precision"), r("recall").alias("recall"))


GRID = [(power, cut, w) for power in (0.5, 1, 1.5, 2) for cut in (0.0, 0.2, 0.4) for w in (0.8, 1.0, 1.2)]
GRID_SQL = (
    "gc(power, cut, scale) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in GRID) + ")",
    "gy AS (SELECT stddev_pop(y) AS ys, quantile_cont(y, 0.99) AS y99, quantile_cont(y, 0.9) AS y90 FROM pp)",
    """gr AS (SELECT power, cut, scale, stddev_pop(f) / (any_value(ys) + 1e-9) AS std_ratio, quantile_cont(f, 0.99) / (any_value(y99) + 1e-9) AS p99_ratio, avg(abs(y - f)) FILTER (y >= y99) AS q99_mae FROM
 (SELECT power, cut, scale, ys, y99, y, scale * CASE WHEN p >= cut THEN pow(p, power) * t + (1 - pow(p, power)) * nt ELSE nt END AS f FROM pp, gy, gc) GROUP BY 1, 2, 3)""",
)


def grid_results(spark, sf_dir):
    """(power, cut, scale, std_ratio, p99_ratio, q99_mae) of every grid point, in one aggregate and one quantile pass."""
    pp = preds(spark, sf_dir)
    y99 = q(pp, "y", 0.99)[0]
    made = {f"{a}|{b}|{c}": F.lit(float(c)) * PO.damped(c_p(), c_t(), c_nt(), a, b) for a, b, c in GRID}
    p99 = fit_quantiles(pp, {f"c{i}": (e, [0.99]) for i, e in enumerate(made.values())})
    m = M.policy_table(pp, made, s=F.stddev_pop, ys=lambda c: F.stddev_pop("y"), q=lambda c: F.avg(F.when(c_y() >= y99, F.abs(c_y() - c))))
    lookup = F.create_map(*[x for i, n in enumerate(made) for x in (F.lit(n), F.lit(p99[f"c{i}"][0]))])
    part = F.split("method", r"\|")
    return m.select(*[part[i].cast("double").alias(n) for i, n in enumerate(("power", "cut", "scale"))], (F.col("s") / (F.col("ys") + 1e-9)).alias("std_ratio"), (lookup[F.col("method")] / (y99 + 1e-9)).alias("p99_ratio"), F.col("q").alias("q99_mae"))


@query("r37_feasible_region", with_sql(PRED_SQL, f"SELECT power, cut, scale, {sr('std_ratio', 5)} AS std_ratio, {sr('p99_ratio', 5)} AS p99_ratio, {sr('q99_mae', 2)} AS q99_mae, std_ratio BETWEEN 0.9 AND 1.1 AND p99_ratio >= 0.85 AS feasible FROM gr WHERE std_ratio BETWEEN 0.9 AND 1.1 OR p99_ratio >= 0.85", *GRID_SQL))
def r37(spark, sf_dir):
    g = grid_results(spark, sf_dir)
    std_ok, tail_ok = F.col("std_ratio").between(0.9, 1.1), F.col("p99_ratio") >= 0.85
    return g.where(std_ok | tail_ok).select("power", "cut", "scale", r("std_ratio", 5).alias("std_ratio"), r("p99_ratio", 5).alias("p99_ratio"), r("q99_mae", 2).alias("q99_mae"), (std_ok & tail_ok).alias("feasible"))


@query("r37_nearest_misses", with_sql(PRED_SQL, f"SELECT power, cut, scale, {sr('p99_ratio', 5)} AS p99_ratio FROM gr WHERE NOT (std_ratio BETWEEN 0.9 AND 1.1 AND p99_ratio >= 0.85) ORDER BY round(abs(std_ratio - 1), 9), power, cut, scale LIMIT 3", *GRID_SQL))
def r37b(spark, sf_dir):
    g = grid_results(spark, sf_dir)
    ok = F.col("std_ratio").between(0.9, 1.1) & (F.col("p99_ratio") >= 0.85)
    return g.where(~ok).orderBy(F.round(F.abs(F.col("std_ratio") - 1), 9), "power", "cut", "scale").limit(3).select("power", "cut", "scale", r("p99_ratio", 5).alias("p99_ratio"))


@query("r37_grid_group_means", with_sql(PRED_SQL, f"SELECT power, {sr('avg(std_ratio)', 5)} AS std_ratio, {sr('avg(p99_ratio)', 5)} AS p99_ratio, {sr('avg(q99_mae)', 2)} AS q99_mae FROM gr GROUP BY 1", *GRID_SQL))
def r37c(spark, sf_dir):
    return grid_results(spark, sf_dir).groupBy("power").agg(r(F.avg("std_ratio"), 5).alias("std_ratio"), r(F.avg("p99_ratio"), 5).alias("p99_ratio"), r(F.avg("q99_mae"), 2).alias("q99_mae"))
