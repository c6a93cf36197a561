"""Derived columns, joins to the layout dimension, schema and projection queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from panelforge.functions import exprs as X, names as N
from panelforge.operators import drift, features as FE, layout as L, panel as P, ranks
from panelforge.operators.quantiles import fit_quantiles
from panelforge.plans.registry import EVENTS_SQL, ORDERS_SQL, PRED_SQL, query, r, sr, with_sql
from panelforge.session import cut_lineage
from panelforge.sources import panels as S

ROLE = {
    "inflow": "qty_sum", "active": "n_lines", "utilization": "disc_avg", "charge_wait": "qty_avg", "low_battery": "tax_avg",
    "skus": "n_lines", "congestion": "tax_avg", "density": "qty_avg", "idle": "qty_max", "battery": "disc_avg",
}
PAIR_COLS = ("qty_sum", "disc_avg", "tax_avg", "qty_max", "n_lines")
PAIRS = list(combinations(PAIR_COLS, 2))


def orders(spark, sf_dir):
    return S.order_panel(spark, sf_dir)


@query("f1_log_transforms", with_sql(EVENTS_SQL, f"SELECT id, {sr('ln(1 + value)')} AS log1p_value, {sr('exp(k / 100.0) - 1')} AS expm1_k, {sr('sign(value - 50) * ln(1 + abs(value - 50))')} AS signed_log FROM ev"))
def f1(spark, sf_dir):
    ev = S.events_panel(spark, sf_dir)
    return ev.select("id", r(F.log1p("value")).alias("log1p_value"), r(F.expm1(F.col("k") / 100.0)).alias("expm1_k"), r(X.signed_log(F.col("value") - 50)).alias("signed_log"))


def pair_sql(a: str, b: str) -> str:
    return (
        f"{sr(f'{a} * {b}', 4)} AS inter_{a}_x_{b}, {sr(f'coalesce({a} / ({b} + 1e-9), 0.0)', 3)} AS ratio_{a}_to_{b}, "
        f"{sr(f'{a} - {b}', 5)} AS diff_{a}_{b}, {sr(f'coalesce(ln(1 + abs({a} * {b})), 0.0)')} AS logprod_{a}_{b}"
    )


@query("f2_pair_interactions", with_sql(ORDERS_SQL, f"SELECT id, {', '.join(pair_sql(a, b) for a, b in PAIRS)} FROM op"))
def f2(spark, sf_dir):
    cols = {}
    for a, b in PAIRS:
        made = P.pair_features(a, b)
        for (n, c), d in zip(made.items(), (4, 3, 5, 6)):
            cols[n] = r(c, d).alias(n)
    return orders(spark, sf_dir).select("id", *cols.values())


EDGE_SQL = "eg AS (SELECT " + ", ".join(f"quantile_cont({c}, {q}) AS {c}{i}" for c in PAIR_COLS for i, q in enumerate(FE.QUINTILES)) + " FROM op WHERE is_train)"


def bin_sql(c: str) -> str:
    inner = " + ".join(f"({c} > {c}{i})::INT" for i in range(1, 5))
    # equal edges are one edge
    dup = " - ".join(["0"] + [f"({c} > {c}{i} AND {c}{i} = {c}{i - 1})::INT" for i in range(1, 5)] + [f"({c} > {c}4 AND {c}4 = {c}5)::INT"])
    return f"CASE WHEN {c} <= {c}5 THEN {inner} + {dup.replace('0 - ', '0 - ', 1)} ELSE 0 END"


@query("f3_quantile_buckets", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"CAST(coalesce({bin_sql(a)}, 0) * 5 + coalesce({bin_sql(b)}, 0) AS INTEGER) AS bucket_{a}_x_{b}" for a, b in PAIRS) + " FROM op, eg", EDGE_SQL))
def f3(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "is_train", *PAIR_COLS))
    edges = FE.fit_bin_edges(op.where("is_train"), PAIR_COLS)
    return op.select("id", *[P.pair_features(a, b, edges)[f"bucket_{a}_x_{b}"].alias(f"bucket_{a}_x_{b}") for a, b in PAIRS])


STEP_SQL = """st AS (SELECT *, qty_sum - lag(qty_sum) OVER (PARTITION BY sid ORDER BY odate, id) AS inflow_step,
 tax_avg - lag(tax_avg) OVER (PARTITION BY sid ORDER BY odate, id) AS congestion_step FROM op)"""


@query("f4_physical_ratios", with_sql(ORDERS_SQL, f"""SELECT id, {sr('inflow_step / (n_lines + 1.0)')} AS surge_velocity, {sr('qty_sum / (disc_avg + 1e-6)', 2)} AS load_utilization_ratio,
 {sr('qty_avg * tax_avg')} AS charging_stress, {sr('n_lines / (qty_sum + 1.0)')} AS robot_density, {sr('n_lines / (qty_sum + 1.0)')} AS sku_density,
 {sr('congestion_step * qty_sum', 5)} AS congestion_surge, {sr('tax_avg * n_lines')} AS battery_starvation FROM st""", STEP_SQL))
def f4(spark, sf_dir):
    def local(d, w):
        return d.select("*", (F.col("qty_sum") - F.lag("qty_sum").over(w)).alias("inflow_step"), (F.col("tax_avg") - F.lag("tax_avg").over(w)).alias("congestion_step"))

    st = P.sequence_features(orders(spark, sf_dir), S.ORDERS, local, 1)
    made = FE.physical_ratios(ROLE, "inflow_step", "congestion_step")
    digits = {"load_utilization_ratio": 2, "congestion_surge": 5}
    return st.select("id", *[r(c, digits.get(n, 6)).alias(n) for n, c in made.items()])


@query("f5_capacity_ratios", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'{ROLE[a]} / ({ROLE[b]} + 1e-6)')} AS {n}" for n, (a, b) in {
    "inflow_per_active": ("inflow", "active"), "congestion_per_active": ("congestion", "active"), "density_per_idle": ("density", "idle"),
    "battery_stress_idle": ("battery", "idle"), "congestion_per_idle": ("congestion", "idle"), "inflow_per_idle": ("inflow", "idle")}.items()) + " FROM op"))
def f5(spark, sf_dir):
    return orders(spark, sf_dir).select("id", *[r(c).alias(n) for n, c in FE.capacity_ratios(ROLE).items()])


@query("f6_early_warning", with_sql(EVENTS_SQL, f"""SELECT id, CAST(CASE WHEN step > 0 AND urel > (SELECT quantile_cont(urel, 0.9) FROM ew WHERE is_train) THEN 1 ELSE 0 END AS INTEGER) AS early_warning_flag,
 {sr('irel + urel')} AS early_warning_score FROM ew""",
    """ew0 AS (SELECT *, value - lag(value) OVER (PARTITION BY sid ORDER BY ts, id) AS step, avg(value) OVER r5 AS vm, avg(k) OVER r5 AS km FROM ev
 WINDOW r5 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
 ew AS (SELECT *, round(CASE WHEN abs(vm) > 1.1920928955078125e-07 THEN (value - vm) / (vm + 1.1920928955078125e-07) ELSE 0.0 END, 9) AS irel,
 round(CASE WHEN abs(km) > 1.1920928955078125e-07 THEN (k - km) / (km + 1.1920928955078125e-07) ELSE 0.0 END, 9) AS urel FROM ew0)"""))
def f6(spark, sf_dir):
    def local(d, w):
        f = P.back(w, 5)
        return d.select(
            "*",
            (F.col("value") - F.lag("value").over(w)).alias("step"),
            F.round(X.relative_to(F.col("value"), F.avg("value").over(f)), 9).alias("irel"),
            F.round(X.relative_to(F.col("k"), F.avg("k").over(f)), 9).alias("urel"),
        )

    ev = P.sequence_features(S.events_panel(spark, sf_dir), S.EVENTS, local, 4)
    p90 = fit_quantiles(ev.where("is_train"), {"u": (F.col("urel"), [0.9])})["u"][0]
    w = FE.early_warning(F.col("step"), F.col("irel"), F.col("urel"), p90)
    return ev.select("id", w["early_warning_flag"].alias("early_warning_flag"), r(w["early_warning_score"]).alias("early_warning_score"))


EXTREME = ("qty_sum", "disc_avg", "tax_avg", "n_lines")


def fit_extremes(train):
    return {c: q[0] for c, q in fit_quantiles(train, {c: (F.col(c), [0.95]) for c in EXTREME}).items()}


@query("f7_extreme_flags", with_sql(ORDERS_SQL, "SELECT id, CAST(coalesce(qty_sum >= q_qty_sum, false) AS INTEGER) AS is_extreme, CAST(" + " OR ".join(f"coalesce({c} >= q_{c}, false)" for c in EXTREME) + " AS INTEGER) AS is_extreme_multi FROM op, xq",
    "xq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.95) AS q_{c}" for c in EXTREME) + " FROM op WHERE is_train)"))
def f7(spark, sf_dir):
    op = orders(spark, sf_dir)
    return op.select("id", *[c.alias(n) for n, c in FE.extreme_flags(fit_extremes(op.where("is_train")), "qty_sum").items()])


@query("f7_extreme_coverage", with_sql(ORDERS_SQL, "SELECT is_train, CAST(count(*) AS BIGINT) AS n, " + sr("avg(CAST((" + " OR ".join(f"coalesce({c} >= q_{c}, false)" for c in EXTREME) + ") AS INTEGER))") + " AS coverage FROM op, xq GROUP BY 1",
    "xq AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.95) AS q_{c}" for c in EXTREME) + " FROM op WHERE is_train)"))
def f7b(spark, sf_dir):
    op = orders(spark, sf_dir)
    flag = FE.extreme_flags(fit_extremes(op.where("is_train")), "qty_sum")["is_extreme_multi"]
    return op.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"), r(F.avg(flag)).alias("coverage"))


@query("f8_clip_to_bounds", with_sql(PRED_SQL, f"SELECT id, least(greatest(oof, 0.0), b) AS clipped FROM pp, (SELECT 1.5 * quantile_cont(y, 0.99) AS b FROM pp) WHERE oof IS NOT NULL"))
def f8(spark, sf_dir):
    pp = S.pred_panel(spark, sf_dir)
    p99 = fit_quantiles(pp, {"y": (F.col("y"), [0.99])})["y"][0]
    return pp.where("has_oof").select("id", X.clip(F.col("oof"), 0.0, 1.5 * p99).alias("clipped"))


@query("f9_f10_f11_gate_weights", with_sql(PRED_SQL, f"""SELECT id, {sr('1.0 / (1.0 + exp(-8.0 * (p - 0.55)))')} AS sigmoid_weight, {sr('w0')} AS blend_weight,
 {sr('least(greatest(1.0 - least(greatest((g0 - 3.0) / 3.0, 0.0), 2.0) * least(greatest((0.7 - p) / 0.7, 0.0), 1.0) * 0.5, 0.5), 1.0)')} AS damping FROM pr1"""))
def f9(spark, sf_dir):
    pp = S.pred_panel(spark, sf_dir)
    p, t, nt = F.col("p"), F.col("t"), F.col("nt")
    return pp.select("id", r(X.sigmoid_gate(p)).alias("sigmoid_weight"), r(X.blend_weight(p, t, nt)).alias("blend_weight"), r(X.damping(p, X.prediction_gap(t, nt))).alias("damping"))


@query("f12_tail_interpolation", with_sql(PRED_SQL, f"""SELECT id, {sr('tf')} AS tail_factor, {sr('nt * (1.0 - tf) + (nt + (t - nt) * 0.5) * tf', 3)} AS ensembled FROM
 (SELECT *, least(greatest((nt - p80) / (p95 - p80 + 1e-9), 0.0), 1.0) AS tf FROM pp, (SELECT quantile_cont(nt, 0.8) AS p80, quantile_cont(nt, 0.95) AS p95 FROM pp))"""))
def f12(spark, sf_dir):
    pp = S.pred_panel(spark, sf_dir)
    p80, p95 = fit_quantiles(pp, {"nt": (F.col("nt"), [0.8, 0.95])})["nt"]
    nt, t = F.col("nt"), F.col("t")
    tf = X.clip((nt - p80) / (p95 - p80 + 1e-9), 0.0, 1.0)
    return pp.select("id", r(tf).alias("tail_factor"), r(nt * (1.0 - tf) + (nt + (t - nt) * 0.5) * tf, 3).alias("ensembled"))


@query("f13_min_max", with_sql(EVENTS_SQL, f"SELECT id, {sr('(value - lo) / (hi - lo + 1e-9)')} AS scaled FROM ev, (SELECT min(value) AS lo, max(value) AS hi FROM ev)"))
def f13(spark, sf_dir):
    ev = S.events_panel(spark, sf_dir).select("id", "value")
    return ev.select("id", r(FE.min_max(ev, "value")).alias("scaled"))


@query("f13_l2_normalise", f"SELECT vec_id AS id, {sr('list_sum(list_transform(v, lambda x: (x / (n + 1e-8)) ^ 2))')} AS unit_length, {sr('v[1] / (n + 1e-8)')} AS first_dim FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def f13b(spark, sf_dir):
    u = S.vectors(spark, sf_dir).select("id", FE.l2_normalise(F.col("v")).alias("u"))
    return u.select("id", r(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)).alias("unit_length"), r(F.col("u")[0]).alias("first_dim"))


@query("f14_logit_entropy", with_sql(PRED_SQL, f"SELECT {sr('avg(ln(p / (1 - p)))')} AS logit_mean, {sr('stddev_pop(ln(p / (1 - p)))')} AS logit_std, {sr('avg(-(p * ln(p) + (1 - p) * ln(1 - p)))')} AS entropy_mean, {sr('stddev_pop(-(p * ln(p) + (1 - p) * ln(1 - p)))')} AS entropy_std, {sr('avg(p)')} AS p_mean, {sr('var_pop(p)')} AS p_var FROM pp WHERE p > 0 AND p < 1"))
def f14(spark, sf_dir):
    p = F.col("p")
    pp = S.pred_panel(spark, sf_dir).where((p > 0) & (p < 1)).select("p", X.logit(p).alias("l"), X.binary_entropy(p).alias("e"))
    return pp.agg(
        r(F.avg("l")).alias("logit_mean"), r(F.stddev_pop("l")).alias("logit_std"), r(F.avg("e")).alias("entropy_mean"),
        r(F.stddev_pop("e")).alias("entropy_std"), r(F.avg("p")).alias("p_mean"), r(F.var_pop("p")).alias("p_var"),
    )


CATEGORY_SQL = """CASE WHEN regexp_matches(feature, '_slope_|_rate_|_diff_') THEN 'Trend' WHEN regexp_matches(feature, '_std_|_volatility_') THEN 'Volatility'
 WHEN starts_with(feature, 'inter_') THEN 'Interaction' ELSE 'Other' END"""
STATS_SQL = ("wide AS (SELECT *, " + ", ".join(f"{a} * {b} AS inter_{a}_x_{b}, {a} / ({b} + 1e-9) AS ratio_{a}_to_{b}" for a, b in PAIRS) + """,
 qty_sum - lag(qty_sum) OVER (PARTITION BY sid ORDER BY odate, id) AS qty_sum_diff_1, (qty_sum - lag(qty_sum) OVER (PARTITION BY sid ORDER BY odate, id)) / (qty_sum + 1.0) AS qty_sum_rate_1,
 stddev_samp(qty_sum) OVER (PARTITION BY sid ORDER BY odate, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS qty_sum_rolling_std_3 FROM op)""")
NAMED = [f"inter_{a}_x_{b}" for a, b in PAIRS] + [f"ratio_{a}_to_{b}" for a, b in PAIRS] + ["qty_sum_diff_1", "qty_sum_rate_1", "qty_sum_rolling_std_3", *S.SENSORS]


def named_features(spark, sf_dir):
    """The order panel with its pair, change and volatility features, under the names the predicates read."""
    def local(d, w):
        step = F.col("qty_sum") - F.lag("qty_sum").over(w)
        pairs = {n: c for a, b in PAIRS for n, c in P.pair_features(a, b).items() if n.startswith(("inter_",))}
        ratios = {f"ratio_{a}_to_{b}": X.ratio(F.col(a), F.col(b), 1e-9) for a, b in PAIRS}
        more = {"qty_sum_diff_1": step, "qty_sum_rate_1": step / (F.col("qty_sum") + 1.0), "qty_sum_rolling_std_3": F.stddev_samp("qty_sum").over(P.back(w, 3))}
        return d.select("*", *[c.alias(n) for n, c in (pairs | ratios | more).items()])

    return P.sequence_features(orders(spark, sf_dir), S.ORDERS, local, 4)


@query("p9_name_categories", with_sql(ORDERS_SQL, f"SELECT feature, {CATEGORY_SQL} AS category, {sr('nan_pct')} AS nan_pct FROM (UNPIVOT (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in NAMED) + " FROM wide) ON COLUMNS(*) INTO NAME feature VALUE nan_pct)", STATS_SQL))
def p9(spark, sf_dir):
    rates = drift.stats_long(named_features(spark, sf_dir), NAMED, nan_pct=lambda c: F.avg(c.isNull().cast("double")))
    return rates.select("feature", N.category(F.col("feature")).alias("category"), r("nan_pct").alias("nan_pct"))


@query("f15_name_predicates", with_sql(ORDERS_SQL, """SELECT starts_with(feature, 'inter_') AS is_interaction, starts_with(feature, 'ratio_') AS is_ratio, ends_with(feature, '_rate_1') AS is_rate,
 regexp_matches(feature, '_(mean|std)_[0-9]+$') AS is_rolling, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(n) AS BIGINT) AS n_values FROM (UNPIVOT (SELECT """ + ", ".join(f"count({c}) AS {c}" for c in NAMED) + " FROM wide) ON COLUMNS(*) INTO NAME feature VALUE n) GROUP BY 1, 2, 3, 4", STATS_SQL))
def f15(spark, sf_dir):
    f = F.col("feature")
    counts = drift.stats_long(named_features(spark, sf_dir), NAMED, n=lambda c: F.count(c))
    return counts.groupBy(
        f.startswith("inter_").alias("is_interaction"), f.startswith("ratio_").alias("is_ratio"), f.endswith("_rate_1").alias("is_rate"), f.rlike("_(mean|std)_[0-9]+$").alias("is_rolling")
    ).agg(F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("n_values"))


# --- joins ----------------------------------------------------------------------------------------------------


@query("j1_fact_left_join_layout", """SELECT c_custkey, c_nationkey, n_name, n_regionkey, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j1(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation").join(F.broadcast(S.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation and region hold 25 and 5 rows at every scale factor
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_nationkey", "n_name", "n_regionkey", "r_name")


LAY = ("qty_sum", "disc_avg")
LAY_SQL = "kn AS (SELECT * FROM op WHERE is_train AND layout % 5 <> 0),\n" + "bl AS (SELECT layout, " + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in LAY) + " FROM kn GROUP BY 1),\nbt AS (SELECT ltype, " + ", ".join(f"avg({c}) AS {c}_t" for c in LAY) + " FROM kn GROUP BY 1),\ngl AS (SELECT " + ", ".join(f"avg({c}) AS {c}_gm, stddev_samp({c}) AS {c}_gs" for c in LAY) + " FROM kn)"


def seen_layouts(op):
    """Training rows of the layouts that are not held out; the rest must be served by the fallbacks."""
    return op.where(F.col("is_train") & (F.col("layout") % 5 != 0))


@query("j2_layout_stats_type_fallback", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'coalesce({c}_m, {c}_t, {c}_gm, 0)')} AS {c}_layout_mean, {sr(f'coalesce({c}_s, {c}_gs, 0)', 5)} AS {c}_layout_std" for c in LAY) + " FROM op LEFT JOIN bl USING (layout) LEFT JOIN bt USING (ltype), gl", LAY_SQL))
def j2(spark, sf_dir):
    op = orders(spark, sf_dir)
    out = L.apply_layout_stats(op, L.fit_layout_stats(seen_layouts(op), LAY))
    return out.select("id", *[r(f"{c}_layout_{m}", 6 if m == "mean" else 5).alias(f"{c}_layout_{m}") for c in LAY for m in ("mean", "std")])


@query("j3_layout_stats_global_fallback", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'coalesce({c}_m, {c}_gm, 0)')} AS {c}_layout_mean, {sr(f'coalesce({c}_s, {c}_gs, 0)', 5)} AS {c}_layout_std" for c in LAY) + " FROM op LEFT JOIN bl USING (layout), gl WHERE NOT is_train", LAY_SQL))
def j3(spark, sf_dir):
    op = orders(spark, sf_dir)
    out = L.apply_layout_stats(op.where("NOT is_train"), L.fit_layout_stats(seen_layouts(op), LAY), use_type=False)
    return out.select("id", *[r(f"{c}_layout_{m}", 6 if m == "mean" else 5).alias(f"{c}_layout_{m}") for c in LAY for m in ("mean", "std")])


BUSY = "busy AS (SELECT o_custkey AS sid FROM orders GROUP BY 1 HAVING count(*) >= 10)"


def busy(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("sid")


@query("j4_semi_join_scenarios", f"WITH {BUSY} SELECT o_orderkey AS id, o_custkey AS sid FROM orders WHERE o_custkey IN (SELECT sid FROM busy)")
def j4(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sid"))
    return o.join(busy(spark, sf_dir), "sid", "left_semi")


@query("j5_anti_join_scenarios", f"WITH {BUSY} SELECT o_orderkey AS id, o_custkey AS sid FROM orders WHERE o_custkey NOT IN (SELECT sid FROM busy)")
def j5(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sid"))
    return o.join(busy(spark, sf_dir), "sid", "left_anti")


@query("j7_golden_merge", f"""WITH sub AS (SELECT o_orderkey AS id, round(o_totalprice * 0.9, 3) AS pred FROM orders),
 gold AS (SELECT o_orderkey AS id, o_totalprice * 0.9 AS pred FROM orders WHERE o_orderstatus <> 'P')
 SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(g.pred IS NULL) AS BIGINT) AS n_unmatched, CAST(count_if(abs(s.pred - g.pred) > 1e-8 + 1e-5 * abs(g.pred)) AS BIGINT) AS n_off
 FROM sub s LEFT JOIN gold g USING (id)""")
def j7(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    sub = o.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 0.9, 3).alias("pred"))
    gold = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 0.9).alias("gold"))
    off = F.abs(F.col("pred") - F.col("gold")) > 1e-8 + 1e-5 * F.abs(F.col("gold"))
    return sub.join(gold, "id", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gold").isNull()).alias("n_unmatched"), F.count_if(off).alias("n_off"))


# --- projections ------------------------------------------------------------------------------------------------


@query("p1_project_schema", with_sql(ORDERS_SQL, "SELECT id, sid, layout, y, qty_sum, disc_avg FROM op"))
def p1(spark, sf_dir):
    return orders(spark, sf_dir).select("id", "sid", "layout", "y", "qty_sum", "disc_avg")


@query("p4_id_number", "SELECT c_custkey, c_name, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS id_num FROM customer")
def p4(spark, sf_dir):
    return S.table(spark, sf_dir, "customer").select("c_custkey", "c_name", X.id_number(F.col("c_name")).alias("id_num"))


@query("p6_sentinel_fills", with_sql(ORDERS_SQL, "SELECT id, coalesce(qty_sum, -999.0) AS filled_sentinel, coalesce(n_lines, 0.0) AS filled_zero, coalesce(qty_avg, (SELECT quantile_cont(qty_avg, 0.5) FROM op WHERE is_train)) AS filled_median FROM op"))
def p6(spark, sf_dir):
    op = orders(spark, sf_dir)
    med = FE.fit_medians(op.where("is_train"), ["qty_avg"])
    return op.select("id", F.coalesce("qty_sum", F.lit(-999.0)).alias("filled_sentinel"), F.coalesce("n_lines", F.lit(0.0)).alias("filled_zero"), F.coalesce("qty_avg", F.lit(med["qty_avg"])).alias("filled_median"))


@query("p7_clean_non_finite", f"""SELECT l_orderkey, l_linenumber, l_suppkey, {sr("CASE WHEN l_discount = 0 OR l_tax = 0 THEN 0.0 ELSE l_tax / l_discount END")} AS ratio, {sr('coalesce(CASE WHEN l_tax > 0 AND l_discount > 0 THEN l_tax / l_discount END, -1.0)')} AS known FROM lineitem""")
def p7(spark, sf_dir):
    # dividing by the reciprocal yields NaN and infinities, which cleaning must turn into NULL
    inv = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1.0 / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    raw = F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), F.lit(float("nan"))).otherwise(F.col("l_tax") * inv)
    li = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_tax", X.clean(raw).alias("c"))
    known = F.when(F.col("l_tax") > 0, F.col("c"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", r(F.coalesce("c", F.lit(0.0))).alias("ratio"), r(F.coalesce(known, F.lit(-1.0))).alias("known"))


@query("p8_canonical_order", with_sql(ORDERS_SQL, "SELECT id, CAST(row_number() OVER (ORDER BY sid, odate, id) - 1 AS BIGINT) AS canonical_pos FROM op"))
def p8(spark, sf_dir):
    from panelforge.operators.prefix import row_positions

    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sid"), F.col("o_orderdate").alias("odate"))
    return row_positions(o, [], ["sid", "odate", "id"], "canonical_pos").select("id", "canonical_pos")


@query("p12_prediction_mask", with_sql(PRED_SQL, f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(oof) AS BIGINT) AS n_valid, {sr('count(oof) * 1.0 / count(*)')} AS valid_rate, {sr('avg(abs(y - oof))', 3)} AS mae FROM pp"))
def p12(spark, sf_dir):
    return S.pred_panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count("oof").alias("n_valid"), r(F.count("oof") / F.count(F.lit(1))).alias("valid_rate"), r(F.avg(F.abs(F.col("y") - F.col("oof"))), 3).alias("mae")
    )


# --- preprocessing ------------------------------------------------------------------------------------------------

SCALED = ("qty_sum", "qty_avg", "disc_avg")


@query("e1_winsorise", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'least(greatest(coalesce({c}, {c}_m), {c}_lo), {c}_hi)')} AS {c}" for c in SCALED) + " FROM op, ws",
    "ws AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in SCALED) + " FROM op WHERE is_train)"))
def e1(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "is_train", *SCALED))
    out = FE.apply_winsor(op, FE.fit_winsor(op.where("is_train"), SCALED))
    return out.select("id", *[r(c).alias(c) for c in SCALED])


@query("e1_winsor_state", with_sql(ORDERS_SQL, "SELECT 'qty_sum_diff_1' AS feature, quantile_cont(d, 0.001) AS low, quantile_cont(d, 0.999) AS high, round(avg(d), 6)::DOUBLE AS mean, round(stddev_pop(d), 5)::DOUBLE AS std FROM (SELECT is_train, qty_sum - lag(qty_sum) OVER (PARTITION BY sid ORDER BY odate, id) AS d FROM op) WHERE is_train"))
def e1b(spark, sf_dir):
    feats = P.sequence_features(orders(spark, sf_dir).select("id", "sid", "odate", "is_train", "qty_sum"), S.ORDERS, lambda d, w: d.withColumn("qty_sum_diff_1", F.col("qty_sum") - F.lag("qty_sum").over(w)), 1)
    train = feats.where("is_train").select("qty_sum_diff_1")
    s = FE.fit_winsor(train, ["qty_sum_diff_1"])["qty_sum_diff_1"]
    one = train.agg(F.count(F.lit(1)).alias("n"))
    return one.select(F.lit("qty_sum_diff_1").alias("feature"), F.lit(s.low).alias("low"), F.lit(s.high).alias("high"), F.round(F.lit(s.mean), 6).alias("mean"), F.round(F.lit(s.std), 5).alias("std"))


@query("e2_standardise", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in SCALED) + " FROM op, (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SCALED) + " FROM op WHERE is_train)"))
def e2(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "is_train", *SCALED))
    return FE.apply_standard(op, FE.fit_standard(op.where("is_train"), SCALED)).select("id", *[r(c).alias(c) for c in SCALED])


@query("e3_median_impute", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'coalesce({c}, {c}_m)')} AS {c}" for c in SCALED) + " FROM op, (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in SCALED) + " FROM op WHERE is_train)"))
def e3(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "is_train", *SCALED))
    return FE.fill_with(op, FE.fit_medians(op.where("is_train"), SCALED)).select("id", *[r(c).alias(c) for c in SCALED])


@query("e4_two_pass_impute", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'coalesce({c}, {c}_g) + coalesce({c}_l - {c}_g, 0)')} AS {c}" for c in SCALED) + " FROM op LEFT JOIN (SELECT layout, " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_l" for c in SCALED) + " FROM op WHERE is_train GROUP BY 1) USING (layout), (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}_g" for c in SCALED) + " FROM op WHERE is_train)"))
def e4(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "layout", "is_train", *SCALED))
    return L.two_pass_impute(op.where("is_train"), op, SCALED).select("id", *[r(c).alias(c) for c in SCALED])


@query("e5_multi_view", with_sql(ORDERS_SQL, f"""SELECT o.id, qty_sum AS raw_view, {sr('sign(qty_sum) * ln(1 + abs(qty_sum))')} AS log_view, {sr('below * 1.0 / ((SELECT count(qty_sum) FROM op WHERE is_train) + 1)')} AS rank_view
 FROM op o LEFT JOIN (SELECT v, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT qty_sum AS v, sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS n FROM op WHERE qty_sum IS NOT NULL GROUP BY 1)) c ON c.v = o.qty_sum"""))
def e5(spark, sf_dir):
    op = orders(spark, sf_dir).select("id", "is_train", "qty_sum")
    out = ranks.rank_against_reference(op, op.where("is_train"), "qty_sum", "rank_view")
    return out.select("id", F.col("qty_sum").alias("raw_view"), r(X.signed_log(F.col("qty_sum"))).alias("log_view"), r("rank_view").alias("rank_view"))
