"""Aggregation, top-k and set queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators import drift, features as FE, panel as P, ranks, splits, tables as TB
from panelforge.operators.prefix import row_positions
from panelforge.operators.quantiles import fit_quantiles
from panelforge.operators.sets import labelled_union, set_overlap
from panelforge.plans.registry import BLOCKS_SQL, EVENTS_SQL, ORDERS_SQL, PRED_SQL, hash_sql, query, r, sr, with_sql
from panelforge.session import cut_lineage
from panelforge.sources import panels as S

SEN = S.SENSORS


def orders(spark, sf_dir):
    return S.order_panel(spark, sf_dir)


def preds(spark, sf_dir):
    return S.pred_panel(spark, sf_dir)


def q(df, col, *probs):
    return fit_quantiles(df, {"x": (F.col(col), list(probs))})["x"]


@query("a1_target_stats", with_sql(PRED_SQL, f"SELECT {sr('avg(y)', 3)} AS mean, {sr('stddev_samp(y)', 3)} AS std, {sr('quantile_cont(y, 0.9)', 3)} AS p90, {sr('quantile_cont(y, 0.99)', 3)} AS p99 FROM pp"))
def a1(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"))
    p90, p99 = q(o, "y", 0.9, 0.99)
    return o.agg(r(F.avg("y"), 3).alias("mean"), r(F.stddev_samp("y"), 3).alias("std")).select("*", r(F.lit(p90), 3).alias("p90"), r(F.lit(p99), 3).alias("p99"))


@query("a2_train_means", with_sql(ORDERS_SQL, "SELECT " + ", ".join(f"{sr(f'avg({c})', 4)} AS {c}" for c in SEN) + " FROM op WHERE is_train"))
def a2(spark, sf_dir):
    return orders(spark, sf_dir).where("is_train").agg(*[r(F.avg(c), 4).alias(c) for c in SEN])


@query("a3_null_ratio", with_sql(ORDERS_SQL, f"SELECT feature, {sr('n')} AS null_ratio FROM (UNPIVOT (SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in (*SEN, "y")) + " FROM op) ON COLUMNS(*) INTO NAME feature VALUE n)"))
def a3(spark, sf_dir):
    return drift.stats_long(orders(spark, sf_dir), [*SEN, "y"], n=lambda c: F.avg(c.isNull().cast("double"))).select("feature", r("n").alias("null_ratio"))


@query("a4_variance", with_sql(ORDERS_SQL, f"SELECT feature, {sr('n', 4)} AS variance FROM (UNPIVOT (SELECT " + ", ".join(f"var_samp({c}) AS {c}" for c in ("n_lines", "qty_sum", "qty_avg", "disc_avg", "tax_avg")) + " FROM op) ON COLUMNS(*) INTO NAME feature VALUE n)"))
def a4(spark, sf_dir):
    return drift.stats_long(orders(spark, sf_dir), ["n_lines", "qty_sum", "qty_avg", "disc_avg", "tax_avg"], n=F.var_samp).select("feature", r("n", 4).alias("variance"))


A5_COLS = ("qty_sum", "qty_avg", "disc_avg", "tax_avg", "price_sum")


@query("a5_layout_group_stats", with_sql(ORDERS_SQL, "SELECT layout, ltype, CAST(grouping(layout) AS INTEGER) AS all_layouts, CAST(grouping(ltype) AS INTEGER) AS all_types, " + ", ".join(f"{sr(f'avg({c})', 5)} AS {c}_mean, {sr(f'stddev_samp({c})', 4)} AS {c}_std" for c in A5_COLS) + " FROM op WHERE is_train GROUP BY GROUPING SETS ((layout), (ltype), ())"))
def a5(spark, sf_dir):
    rows = orders(spark, sf_dir).where("is_train")
    stats = [x for c in A5_COLS for x in (r(F.avg(c), 5).alias(f"{c}_mean"), r(F.stddev_samp(c), 4).alias(f"{c}_std"))]
    kinds = [F.grouping("layout").cast("int").alias("all_layouts"), F.grouping("ltype").cast("int").alias("all_types")]
    return rows.groupingSets([["layout"], ["ltype"], []], "layout", "ltype").agg(*kinds, *stats)


@query("a6_scenario_profile", with_sql(EVENTS_SQL, "SELECT sid, " + ", ".join(f"{sr(f'avg({c})')} AS {c}_mean, {sr(f'stddev_samp({c})', 5)} AS {c}_std, max({c}) AS {c}_max, min({c}) AS {c}_min" for c in ("value", "k")) + " FROM ev GROUP BY 1"))
def a6(spark, sf_dir):
    aggs = [a for c in ("value", "k") for a in (r(F.avg(c)).alias(f"{c}_mean"), r(F.stddev_samp(c), 5).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"))]
    return S.events_panel(spark, sf_dir).groupBy("sid").agg(*aggs)


@query("a7_type_inference", with_sql(ORDERS_SQL, """SELECT feature, CASE WHEN whole AND u < least(100.0, 0.1 * (SELECT count(*) FROM op)) THEN 'count' WHEN lo >= -1e-5 AND hi <= 1.00001 AND u > 10 THEN 'ratio' ELSE 'sensor' END AS kind, CAST(u AS BIGINT) AS n_unique
 FROM (SELECT feature, count(DISTINCT v) AS u, min(v) AS lo, max(v) AS hi, bool_and(v % 1 = 0) AS whole FROM (UNPIVOT (SELECT """ + ", ".join(SEN) + " FROM op) ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY 1)"))
def a7(spark, sf_dir):
    return TB.infer_kinds(orders(spark, sf_dir), SEN).select("feature", "kind", "n_unique")


@query("a8_scenario_order", with_sql(EVENTS_SQL, "SELECT sid, min(id) AS first_id, CAST(row_number() OVER (ORDER BY min(id)) - 1 AS BIGINT) AS pos FROM ev GROUP BY 1"))
def a8(spark, sf_dir):
    return splits.scenario_order(S.events_panel(spark, sf_dir).select("sid", "id"))


CORR_SQL = "fl AS (SELECT y, is_train, id, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM op)) AS {c}" for c in SEN) + " FROM op)"


def pair_list(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def corr_pairs_sql(cols, src):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM {src}" for a, b in pair_list(cols))


def filled(spark, sf_dir):
    op = cut_lineage(orders(spark, sf_dir).select("id", "y", "is_train", *SEN))  # medians and the filled rows both read it
    return FE.fill_with(op, FE.fit_medians(op, SEN))


@query("a9_correlation_matrix", with_sql(ORDERS_SQL, f"SELECT feature_a, feature_b, {sr('abs(corr)')} AS abs_corr FROM ({corr_pairs_sql(SEN, 'fl')})", CORR_SQL))
def a9(spark, sf_dir):
    return TB.correlation_pairs(filled(spark, sf_dir), SEN).select("feature_a", "feature_b", r(F.abs("corr")).alias("abs_corr"))


@query("a10_exact_quantiles", with_sql(PRED_SQL, "SELECT " + ", ".join(f"{sr(f'quantile_cont({c}, {p})', 3)} AS {c}_q{int(p * 1000)}" for c in ("y", "oof") for p in (0.001, 0.01, 0.25, 0.5, 0.95, 0.99)) + " FROM pp"))
def a10(spark, sf_dir):
    ps = (0.001, 0.01, 0.25, 0.5, 0.95, 0.99)
    pp = preds(spark, sf_dir)
    got = fit_quantiles(pp, {c: (F.col(c), list(ps)) for c in ("y", "oof")})
    return pp.agg(F.count(F.lit(1)).alias("n")).select(*[r(F.lit(v), 3).alias(f"{c}_q{int(p * 1000)}") for c in ("y", "oof") for p, v in zip(ps, got[c])])


@query("a11_fixed_histogram", with_sql(PRED_SQL, "SELECT CAST(least(floor(p / 0.2), 4) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(count_if(y >= 300000) AS BIGINT) AS n_high FROM pp GROUP BY 1"))
def a11(spark, sf_dir):
    return preds(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") / 0.2), F.lit(4)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") >= 300000).alias("n_high"))


@query("a12_labelled_bins", with_sql(EVENTS_SQL, "SELECT CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' WHEN value <= 150 THEN 'high' ELSE 'extreme' END AS band, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1"))
def a12(spark, sf_dir):
    v = F.col("value")
    band = F.when(v <= 10, "low").when(v <= 50, "mid").when(v <= 150, "high").otherwise("extreme")
    return TB.counts_by(S.events_panel(spark, sf_dir), band.alias("band"))


TAIL_SQL = "tl AS (SELECT *, y >= (SELECT quantile_cont(y, 0.9) FROM pp) AS tail FROM pp)"


def tailed(spark, sf_dir):
    pp = preds(spark, sf_dir)
    return pp.withColumn("tail", F.col("y") >= q(pp, "y", 0.9)[0])


CONF = {"tp": "tail AND w > 0.3", "fp": "NOT tail AND w > 0.3", "fn": "tail AND w <= 0.3"}


@query("a14_confusion_counts", with_sql(PRED_SQL, "SELECT " + ", ".join(f"CAST(count_if({c}) AS BIGINT) AS {n}" for n, c in CONF.items()) + f", {sr('count_if(tail AND w > 0.3) * 1.0 / count_if(w > 0.3)')} AS precision, {sr('count_if(tail AND w > 0.3) * 1.0 / count_if(tail)')} AS recall FROM tl", TAIL_SQL))
def a14(spark, sf_dir):
    n = {k: F.count_if(F.expr(c)) for k, c in CONF.items()}
    return tailed(spark, sf_dir).agg(
        *[c.alias(k) for k, c in n.items()], r(F.try_divide(n["tp"], n["tp"] + n["fp"])).alias("precision"), r(F.try_divide(n["tp"], n["tp"] + n["fn"])).alias("recall")
    )


CLASS_SQL = "CASE WHEN tail AND w > 0.3 THEN 'TP' WHEN w > 0.3 THEN 'FP' WHEN tail THEN 'FN' ELSE 'BULK' END"


def outcome():
    w = F.col("w") > 0.3
    return F.when(F.col("tail") & w, "TP").when(w, "FP").when(F.col("tail"), "FN").otherwise("BULK")


@query("a15_outcome_class_means", with_sql(ORDERS_SQL + "," + PRED_SQL, f"""SELECT *, abs(tp - fp) / (abs(tp) + 1e-9) > 0.3 AS wide_gap FROM (SELECT feature, {', '.join(f"round(avg(CASE WHEN cls = '{c}' THEN v END) + 3.7e-8::DOUBLE, 4)::DOUBLE AS {c.lower()}" for c in ('TP', 'FP', 'FN', 'BULK'))}
 FROM (UNPIVOT (SELECT {CLASS_SQL} AS cls, n_lines, qty_sum, qty_avg, disc_avg, tax_avg FROM tl JOIN op USING (id)) ON n_lines, qty_sum, qty_avg, disc_avg, tax_avg INTO NAME feature VALUE v) GROUP BY 1)""", TAIL_SQL))
def a15(spark, sf_dir):
    cols = ["n_lines", "qty_sum", "qty_avg", "disc_avg", "tax_avg"]
    rows = tailed(spark, sf_dir).select("id", outcome().alias("cls")).join(orders(spark, sf_dir).select("id", *cols), "id")
    stats = {c.lower(): (lambda col, c=c: r(F.avg(F.when(F.col("cls") == c, col)), 4)) for c in ("TP", "FP", "FN", "BULK")}
    return drift.stats_long(rows, cols, **stats).withColumn("wide_gap", F.abs(F.col("tp") - F.col("fp")) / (F.abs("tp") + 1e-9) > 0.3)


@query("a16_scenario_tail_rate", with_sql(PRED_SQL, f"SELECT {sr('avg(t)')} AS mean_rate, {sr('var_pop(t)')} AS var_rate, {sr('max(t) - min(t)')} AS range_rate, CAST(count(*) AS BIGINT) AS n FROM (SELECT sid, avg(CASE WHEN tail THEN 1.0 ELSE 0.0 END) AS t FROM tl GROUP BY 1)", TAIL_SQL))
def a16(spark, sf_dir):
    per = tailed(spark, sf_dir).groupBy("sid").agg(F.avg(F.col("tail").cast("double")).alias("t"))
    return per.agg(r(F.avg("t")).alias("mean_rate"), r(F.var_pop("t")).alias("var_rate"), r(F.max("t") - F.min("t")).alias("range_rate"), F.count(F.lit(1)).alias("n"))


LINE_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINE_NUMBERS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6), round(l_extendedprice, 6), round(l_discount, 6), round(l_tax, 6)"


@query("a17_duplicate_rows", f"""SELECT CAST(d AS BIGINT) AS duplicates, CAST(e AS BIGINT) AS near_duplicates, CASE WHEN e > 0 THEN 'HIGH' ELSE 'SAFE' END AS risk_status FROM
 (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM lineitem GROUP BY {LINE_COLS})), (SELECT sum(n - 1) AS e FROM (SELECT count(*) AS n FROM lineitem GROUP BY {LINE_NUMBERS}))""")
def a17(spark, sf_dir):
    return TB.duplicate_counts(S.table(spark, sf_dir, "lineitem").select(*LINE_COLS.split(", ")))


@query("a18_label_inconsistency", f"SELECT CAST(count(*) AS BIGINT) AS n_groups, {sr('avg(CASE WHEN m > 0 AND m < 1 THEN 1.0 ELSE 0.0 END)')} AS inconsistent_share FROM (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS m FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING count(*) > 1)")
def a18(spark, sf_dir):
    g = S.table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_discount", "l_tax").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    mixed = (F.col("m") > 0) & (F.col("m") < 1)
    return g.where("n > 1").agg(F.count(F.lit(1)).alias("n_groups"), r(F.avg(mixed.cast("double"))).alias("inconsistent_share"))


P_BINS = [0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0]


@query("a20_binned_tail_rate", with_sql(PRED_SQL, "SELECT CAST(" + " + ".join(f"(p > {b})::INT" for b in P_BINS[1:-1]) + f" AS INTEGER) AS p_bin, {sr('avg(CASE WHEN tail THEN 1.0 ELSE 0.0 END)')} AS tail_rate, CAST(count(*) AS BIGINT) AS n FROM tl WHERE p > 0 GROUP BY 1", TAIL_SQL))
def a20(spark, sf_dir):
    t = tailed(spark, sf_dir).where("p > 0")
    return t.groupBy(X.right_closed_bin(F.col("p"), P_BINS).alias("p_bin")).agg(r(F.avg(F.col("tail").cast("double"))).alias("tail_rate"), F.count(F.lit(1)).alias("n"))


@query("a22_data_snapshot", with_sql(ORDERS_SQL, "SELECT dtype, CAST(n_columns AS BIGINT) AS n_columns, (SELECT count(*) FROM op) AS n_rows, CAST(n_null AS BIGINT) AS n_null FROM (VALUES ('double', 8, (SELECT " + " + ".join(f"count_if({c} IS NULL)" for c in (*SEN, 'y')) + " FROM op)), ('bigint', 2, 0), ('int', 2, 0), ('timestamp_ntz', 1, 0), ('boolean', 1, 0)) t(dtype, n_columns, n_null)"))
def a22(spark, sf_dir):
    return TB.snapshot(orders(spark, sf_dir))


# --- top-k ---------------------------------------------------------------------------------------------------------

SCEN_SQL = "sc AS (SELECT sid, avg(abs(y - oof)) AS mae, count(*) AS n, avg(y) AS tm, stddev_samp(y) AS ts, avg(oof) AS pm, stddev_samp(oof) AS ps FROM pp WHERE oof IS NOT NULL GROUP BY 1)"


def scenario_report(spark, sf_dir):
    err = F.abs(F.col("y") - F.col("oof"))
    return preds(spark, sf_dir).where("has_oof").groupBy("sid").agg(
        F.avg(err).alias("mae"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("tm"), F.stddev_samp("y").alias("ts"), F.avg("oof").alias("pm"), F.stddev_samp("oof").alias("ps")
    )


SCEN_OUT = f"sid, {sr('mae', 3)} AS mae, CAST(n AS BIGINT) AS n, {sr('tm', 3)} AS target_mean, {sr('ts', 3)} AS target_std, {sr('pm', 3)} AS pred_mean, {sr('ps', 3)} AS pred_std"


@query("t1_worst_best_scenarios", with_sql(PRED_SQL, f"SELECT * FROM (SELECT 'worst' AS side, {SCEN_OUT} FROM sc ORDER BY sc.mae DESC, sid LIMIT 10) UNION ALL SELECT * FROM (SELECT 'best' AS side, {SCEN_OUT} FROM sc ORDER BY sc.mae, sid LIMIT 10)", SCEN_SQL))
def t1(spark, sf_dir):
    rep = scenario_report(spark, sf_dir)
    out = [F.col("sid"), r("mae", 3).alias("mae"), F.col("n"), r("tm", 3).alias("target_mean"), r("ts", 3).alias("target_std"), r("pm", 3).alias("pred_mean"), r("ps", 3).alias("pred_std")]
    worst = rep.orderBy(F.desc("mae"), "sid").limit(10).select(F.lit("worst").alias("side"), *out)
    return worst.unionByName(rep.orderBy("mae", "sid").limit(10).select(F.lit("best").alias("side"), *out))


@query("t2_largest_smallest_features", with_sql(ORDERS_SQL, f"SELECT * FROM (SELECT 'high' AS side, feature, {sr('c')} AS abs_corr FROM yc ORDER BY c DESC, feature LIMIT 3) UNION ALL SELECT * FROM (SELECT 'low' AS side, feature, {sr('c')} AS abs_corr FROM yc ORDER BY c, feature LIMIT 3)",
    "yc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr(y, {c})) AS c FROM op" for c in SEN) + ")"))
def t2(spark, sf_dir):
    c = drift.stats_long(orders(spark, sf_dir), SEN, c=lambda x: F.abs(X.corr(F.col("y"), x)))
    pick = lambda side, order: c.orderBy(order, "feature").limit(3).select(F.lit(side).alias("side"), "feature", r("c").alias("abs_corr"))
    return pick("high", F.desc("c")).unionByName(pick("low", F.asc("c")))


@query("t3_top_error_rows", with_sql(ORDERS_SQL + "," + PRED_SQL, f"SELECT id, pp.sid, pp.y AS true_value, oof AS pred, {sr('abs(pp.y - oof)', 3)} AS error, n_lines, qty_sum, disc_avg FROM pp JOIN op USING (id) WHERE oof IS NOT NULL ORDER BY abs(pp.y - oof) DESC, id LIMIT 50"))
def t3(spark, sf_dir):
    top = preds(spark, sf_dir).where("has_oof").withColumn("e", F.abs(F.col("y") - F.col("oof"))).orderBy(F.desc("e"), "id").limit(50)
    # fifty rows: small enough for any join strategy
    return orders(spark, sf_dir).select("id", "n_lines", "qty_sum", "disc_avg").join(F.broadcast(top), "id").select(
        "id", "sid", F.col("y").alias("true_value"), F.col("oof").alias("pred"), r("e", 3).alias("error"), "n_lines", "qty_sum", "disc_avg"
    )


KS_PCT = (0.01, 0.03, 0.05, 0.10, 0.20)
RANK_SQL = "rk AS (SELECT *, (rank() OVER (ORDER BY p DESC) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS rp FROM tl)"


def ranked(spark, sf_dir):
    t = ranks.tie_ranks(tailed(spark, sf_dir), [], "p", "k")
    return t.withColumn("rp", (F.col("k_n") + 1 - F.col("k")) / F.col("k_n")).drop("k", "k_n")


@query("t4_recall_at_top_k", with_sql(PRED_SQL, " UNION ALL ".join(f"SELECT {k}::DOUBLE AS k_pct, CAST(count_if(rp <= {k}) AS BIGINT) AS n, {sr(f'count_if(tail AND rp <= {k}) * 1.0 / count_if(tail)')} AS recall, {sr(f'count_if(tail AND rp <= {k}) * 1.0 / nullif(count_if(rp <= {k}), 0)')} AS precision FROM rk" for k in KS_PCT), TAIL_SQL, RANK_SQL))
def t4(spark, sf_dir):
    rk = ranked(spark, sf_dir)
    aggs = [a for i, k in enumerate(KS_PCT) for a in (F.count_if(F.col("rp") <= k).alias(f"n{i}"), F.count_if(F.col("tail") & (F.col("rp") <= k)).alias(f"t{i}"))]
    wide = rk.agg(F.count_if("tail").alias("tails"), *aggs)
    cells = [F.struct(F.lit(float(k)).alias("k_pct"), F.col(f"n{i}").alias("n"), r(F.col(f"t{i}") / F.col("tails")).alias("recall"), r(F.try_divide(F.col(f"t{i}"), F.col(f"n{i}"))).alias("precision")) for i, k in enumerate(KS_PCT)]
    return wide.select(F.inline(F.array(*cells)))


@query("t5_top_two_per_group", with_sql(ORDERS_SQL, "SELECT layout, id, qty_sum, CAST(rn AS INTEGER) AS rn FROM (SELECT layout, id, qty_sum, row_number() OVER (PARTITION BY layout ORDER BY qty_sum DESC NULLS LAST, id) AS rn FROM op) WHERE rn <= 2"))
def t5(spark, sf_dir):
    w = W.partitionBy("layout").orderBy(F.desc_nulls_last("qty_sum"), "id")
    # the rank limit is pushed below the shuffle, so a hot layout sends two rows per task
    return orders(spark, sf_dir).select("layout", "id", "qty_sum", F.row_number().over(w).alias("rn")).where("rn <= 2")


@query("t6_top_share_scenarios", with_sql(PRED_SQL, f"SELECT sid, {sr('mae', 3)} AS mae FROM (SELECT *, row_number() OVER (ORDER BY sc.mae DESC, sid) AS rn, count(*) OVER () AS n_all FROM sc) WHERE rn <= greatest(1, floor(n_all * 0.2))", SCEN_SQL))
def t6(spark, sf_dir):
    return splits.top_share(scenario_report(spark, sf_dir).select("sid", "mae"), "mae", "sid", 0.2).select("sid", r("mae", 3).alias("mae"))


@query("t7_rank_of_positives", with_sql(PRED_SQL, f"SELECT {sr('quantile_cont(rp::DOUBLE, 0.25)')} AS q25, {sr('quantile_cont(rp::DOUBLE, 0.5)')} AS median, {sr('quantile_cont(rp::DOUBLE, 0.75)')} AS q75, CAST(count(*) AS BIGINT) AS n FROM rk WHERE tail", TAIL_SQL, RANK_SQL))
def t7(spark, sf_dir):
    pos = ranked(spark, sf_dir).where("tail").select("rp")
    a, b, c = q(pos, "rp", 0.25, 0.5, 0.75)
    return pos.agg(F.count(F.lit(1)).alias("n")).select(r(F.lit(a)).alias("q25"), r(F.lit(b)).alias("median"), r(F.lit(c)).alias("q75"), "n")


# --- sets -----------------------------------------------------------------------------------------------------------


@query("u1_labelled_union", with_sql(EVENTS_SQL, "SELECT id, value, 0 AS is_test FROM ev WHERE is_train UNION ALL SELECT id, value, 1 AS is_test FROM ev WHERE NOT is_train"))
def u1(spark, sf_dir):
    ev = S.events_panel(spark, sf_dir).select("id", "value", "is_train")
    return labelled_union(ev.where("is_train").drop("is_train"), ev.where("NOT is_train").drop("is_train"))


FOLD_TOP_SQL = "ft AS (SELECT * FROM (SELECT fold, feature, c, row_number() OVER (PARTITION BY fold ORDER BY c DESC, feature) AS rn FROM (SELECT id % 5 AS fold, feature, abs(corr(y, v)) AS c FROM (UNPIVOT (SELECT id, y, " + ", ".join(SEN) + " FROM op) ON " + ", ".join(SEN) + " INTO NAME feature VALUE v) GROUP BY 1, 2)) WHERE rn <= 6)"


def fold_top(spark, sf_dir):
    """The six features most correlated with the target in each fold."""
    from panelforge.operators.prefix import melt

    long = melt(orders(spark, sf_dir).withColumn("fold", (F.col("id") % 5).cast("int")), ["fold", "y"], SEN)
    c = long.groupBy("fold", "feature").agg(F.abs(X.corr("y", "value")).alias("c"))
    w = W.partitionBy("fold").orderBy(F.desc("c"), "feature")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("fold", "feature")


@query("u2_stable_over_folds", with_sql(ORDERS_SQL, "SELECT feature, CAST(count(DISTINCT fold) AS BIGINT) AS n_folds FROM ft GROUP BY 1 HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM ft)", FOLD_TOP_SQL))
def u2(spark, sf_dir):
    ft = fold_top(spark, sf_dir)
    n = ft.agg(F.count_distinct("fold").alias("n")).scalar()
    return ft.groupBy("feature").agg(F.count_distinct("fold").alias("n_folds")).where(F.col("n_folds") == n)


@query("u3_unknown_layouts", with_sql(ORDERS_SQL, "SELECT sid FROM op WHERE NOT is_train EXCEPT SELECT sid FROM op WHERE is_train"))
def u3(spark, sf_dir):
    rows = orders(spark, sf_dir)
    return rows.where("NOT is_train").select("sid").subtract(rows.where("is_train").select("sid"))


@query("u4_fold_overlap_jaccard", with_sql(ORDERS_SQL, f"SELECT CAST(a.fold AS INTEGER) AS fold_a, CAST(b.fold AS INTEGER) AS fold_b, CAST(count_if(a.feature = b.feature) AS BIGINT) AS common, {sr('count_if(a.feature = b.feature) * 1.0 / (12 - count_if(a.feature = b.feature))')} AS jaccard FROM ft a JOIN ft b ON a.fold < b.fold GROUP BY 1, 2", FOLD_TOP_SQL))
def u4(spark, sf_dir):
    return set_overlap(fold_top(spark, sf_dir), "fold", "feature").withColumn("jaccard", r("jaccard"))


@query("u5_side_overlap", with_sql(EVENTS_SQL, "SELECT (SELECT count(*) FROM (SELECT sid FROM ev WHERE is_train INTERSECT SELECT sid FROM ev WHERE NOT is_train)) AS common_scenarios, max(CASE WHEN is_train THEN id END) AS train_max, min(CASE WHEN NOT is_train THEN id END) AS test_min, max(CASE WHEN is_train THEN id END) < min(CASE WHEN NOT is_train THEN id END) AS in_order FROM ev"))
def u5(spark, sf_dir):
    ev = S.events_panel(spark, sf_dir).select("sid", "id", "is_train")
    per = ev.groupBy("sid").agg(F.bool_or("is_train").alias("a"), F.bool_or(~F.col("is_train")).alias("b"), F.max(F.when(F.col("is_train"), F.col("id"))).alias("hi"), F.min(F.when(~F.col("is_train"), F.col("id"))).alias("lo"))
    return per.agg(F.count_if(F.col("a") & F.col("b")).alias("common_scenarios"), F.max("hi").alias("train_max"), F.min("lo").alias("test_min")).withColumn("in_order", F.col("train_max") < F.col("test_min"))


# --- splits ----------------------------------------------------------------------------------------------------------

CHUNK_SQL = """so AS (SELECT sid, row_number() OVER (ORDER BY min(id)) - 1 AS pos, count(*) OVER () AS n FROM bp GROUP BY 1),
ck AS (SELECT sid, pos, CAST(CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END AS INTEGER) AS chunk FROM so),
cr AS (SELECT bp.*, chunk FROM bp JOIN ck USING (sid)),
fd AS (SELECT f.fold, CASE WHEN chunk <= f.fold + 1 THEN 'train' ELSE 'val' END AS role, cr.* FROM cr JOIN (SELECT unnest(range(5))::INTEGER AS fold) f ON chunk <= f.fold + 2)"""


@query("x1_time_aware_folds", with_sql(BLOCKS_SQL, "SELECT id, sid, chunk FROM cr", CHUNK_SQL))
def x1(spark, sf_dir):
    return splits.time_aware_folds(S.block_panel(spark, sf_dir).select("id", "sid")).select("id", "sid", "chunk")


@query("x2_temporal_leak_check", with_sql(BLOCKS_SQL, "SELECT fold, CAST(count_if(role = 'train') AS BIGINT) AS n_train, CAST(count_if(role = 'val') AS BIGINT) AS n_val, max(CASE WHEN role = 'train' THEN id END) AS train_max, min(CASE WHEN role = 'val' THEN id END) AS val_min, max(CASE WHEN role = 'train' THEN id END) >= min(CASE WHEN role = 'val' THEN id END) AS leaks FROM fd GROUP BY 1", CHUNK_SQL))
def x2(spark, sf_dir):
    return splits.fold_ranges(splits.time_aware_folds(S.block_panel(spark, sf_dir).select("id", "sid")))


@query("x2_leak_is_reported", with_sql(EVENTS_SQL, "SELECT fold, CAST(count_if(role = 'train') AS BIGINT) AS n_train, CAST(count_if(role = 'val') AS BIGINT) AS n_val, max(CASE WHEN role = 'train' THEN id END) AS train_max, min(CASE WHEN role = 'val' THEN id END) AS val_min, max(CASE WHEN role = 'train' THEN id END) >= min(CASE WHEN role = 'val' THEN id END) AS leaks FROM fd GROUP BY 1", CHUNK_SQL.replace("bp", "ev")))
def x2b(spark, sf_dir):
    return splits.fold_ranges(splits.time_aware_folds(S.events_panel(spark, sf_dir).select("id", "sid")))


@query("x3_group_folds", with_sql(EVENTS_SQL, f"SELECT id, sid, CAST({hash_sql('sid')} % 5 AS INTEGER) AS fold FROM ev"))
def x3(spark, sf_dir):
    return S.events_panel(spark, sf_dir).select("id", "sid", splits.hash_fold(5, F.col("sid")).alias("fold"))


@query("x4_stratified_folds", with_sql(EVENTS_SQL, f"SELECT id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('id', digits=13)}, id) - 1) % 3 AS INTEGER) AS fold FROM ev"))
def x4(spark, sf_dir):
    return splits.stratified_folds(S.events_panel(spark, sf_dir).select("id", "event_type"), "event_type", 3, "id")


@query("x5_row_and_scenario_holdout", with_sql(EVENTS_SQL, f"SELECT id, sid, {hash_sql('id')} / 4294967296.0 < 0.2 AS row_val, {hash_sql('sid')} / 4294967296.0 < 0.2 AS scenario_val FROM ev"))
def x5(spark, sf_dir):
    return S.events_panel(spark, sf_dir).select("id", "sid", (splits.unit_hash(F.col("id")) < 0.2).alias("row_val"), (splits.unit_hash(F.col("sid")) < 0.2).alias("scenario_val"))


@query("x6_temporal_holdout", with_sql(BLOCKS_SQL, "SELECT bp.id, bp.sid, so.pos >= floor(so.n * 0.8) AS is_val FROM bp JOIN so USING (sid)", CHUNK_SQL))
def x6(spark, sf_dir):
    bp = S.block_panel(spark, sf_dir).select("id", "sid")
    n = bp.agg(F.count_distinct("sid").alias("n")).scalar()
    order = splits.scenario_order(bp).select("sid", (F.col("pos") >= F.floor(n * 0.8)).alias("is_val"))
    return bp.join(order, "sid").select("id", "sid", "is_val")


@query("x7_decile_stratified_sample", "WITH q AS (SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM orders), d AS (SELECT o_orderkey AS id, o_totalprice AS y, CAST("
 + " + ".join(f"(o_totalprice > e{i})::INT" for i in range(1, 10)) + f""" AS INTEGER) AS decile FROM orders, q)
 SELECT id, y, decile FROM (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY {hash_sql('id', digits=13)}, id) - 1 AS pos, count(*) OVER (PARTITION BY decile) AS n FROM d) WHERE pos < floor(n * 0.4)""")
def x7(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))
    edges = q(o, "y", *[i / 10 for i in range(11)])
    return splits.stratified_sample(o.withColumn("decile", X.right_closed_bin(F.col("y"), edges)), ["decile"], 0.4, "id")


@query("x8_capped_sample", with_sql(EVENTS_SQL, f"SELECT id, value FROM ev ORDER BY {hash_sql('id', digits=13)}, id LIMIT 5000"))
def x8(spark, sf_dir):
    return splits.hash_sample(S.events_panel(spark, sf_dir).select("id", "value"), 5000, "id")


@query("x10_layout_holdout", with_sql(ORDERS_SQL, f"SELECT id, layout, {hash_sql('layout')} / 4294967296.0 < 0.2 AS hidden FROM op"))
def x10(spark, sf_dir):
    return orders(spark, sf_dir).select("id", "layout", (splits.unit_hash(F.col("layout")) < 0.2).alias("hidden"))


@query("x11_bootstrap_segments")
def x11(spark, sf_dir):
    """Each row is drawn a Poisson(0.2) number of times, from a hash of its id, so that the draw does not depend on partitioning."""
    seg = preds(spark, sf_dir).where("has_oof").select("id", F.abs(F.col("y") - F.col("oof")).alias("e"))
    reach, term = [0.0], math.exp(-0.2)
    for k in range(1, 8):
        reach.append(reach[-1] + term)
        term *= 0.2 / k
    drawn = seg.select("e", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("segment"), "id")
    times = sum(((splits.unit_hash(F.col("id"), F.col("segment")) >= c).cast("int") for c in reach[1:]), F.lit(0))
    drawn = drawn.withColumn("w", times)
    return drawn.groupBy("segment").agg(F.sum("w").alias("n"), F.try_divide(F.sum(F.col("w") * F.col("e")), F.sum("w")).alias("mae"))


@query("x12_fold_size_asymmetry", with_sql(BLOCKS_SQL, f"""SELECT fold, CAST(count_if(role = 'train') AS BIGINT) AS n_train, CAST(count_if(role = 'val') AS BIGINT) AS n_val, {sr("count_if(role = 'train') * 1.0 / (SELECT count(*) FROM bp)")} AS train_pct,
 CAST(count(DISTINCT CASE WHEN role = 'train' THEN sid END) AS BIGINT) AS train_scenarios, CAST(count(DISTINCT CASE WHEN role = 'val' THEN sid END) AS BIGINT) AS val_scenarios FROM fd GROUP BY 1""", CHUNK_SQL))
def x12(spark, sf_dir):
    rows = splits.time_aware_folds(S.block_panel(spark, sf_dir).select("id", "sid"))
    per = rows.groupBy("chunk", "sid").agg(F.count(F.lit(1)).alias("n")).groupBy("chunk").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"))
    sides = per.select("n", "s", F.inline(splits.fold_sides(F.col("chunk"))))
    pick = lambda role, c: F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    total = per.agg(F.sum("n").alias("n")).scalar()
    return sides.groupBy("fold").agg(pick("train", "n").alias("n_train"), pick("val", "n").alias("n_val"), pick("train", "s").alias("train_scenarios"), pick("val", "s").alias("val_scenarios")).withColumn("train_pct", r(F.col("n_train") / total))


@query("u6_layout_overlap_per_fold", with_sql(ORDERS_SQL, f"""SELECT fold, CAST(count_if(is_val) AS BIGINT) AS val_layouts, CAST(count_if(is_val AND is_tr) AS BIGINT) AS shared, {sr('count_if(is_val AND is_tr) / (count_if(is_val) + 1e-9)')} AS overlap_ratio FROM
 (SELECT f.fold, layout, bool_or(op.id % 5 = f.fold) AS is_val, bool_or(op.id % 5 <> f.fold) AS is_tr FROM op JOIN (SELECT unnest(range(5))::INTEGER AS fold) f ON true GROUP BY 1, 2) GROUP BY 1"""))
def u6(spark, sf_dir):
    seen = orders(spark, sf_dir).select("layout", (F.col("id") % 5).cast("int").alias("own")).distinct()
    sides = seen.select("layout", "own", F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("fold"))
    per = sides.groupBy("fold", "layout").agg(F.bool_or(F.col("own") == F.col("fold")).alias("v"), F.bool_or(F.col("own") != F.col("fold")).alias("t"))
    both = F.count_if(F.col("v") & F.col("t"))
    return per.groupBy("fold").agg(F.count_if("v").alias("val_layouts"), both.alias("shared"), r(both / (F.count_if("v") + 1e-9)).alias("overlap_ratio"))
