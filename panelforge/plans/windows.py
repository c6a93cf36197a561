"""Ordered-panel queries (window operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators import drift, panel as P, ranks
from panelforge.operators.prefix import prefix_scan, row_positions
from panelforge.operators.quantiles import fit_quantiles
from panelforge.plans.registry import BLOCKS_SQL, EVENTS_SQL, ORDERS_SQL, PRED_SQL, query, r, sr, with_sql
from panelforge.sources import panels as S

WIN = """WINDOW w AS (PARTITION BY sid ORDER BY ts, id),
 r3 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
 r5 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 r10 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
 upto AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 past AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
OWIN = WIN.replace("ts, id", "odate, id")
TYPES = {"n_lines": "count", "disc_avg": "ratio", "qty_avg": "sensor"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events_panel(spark, sf_dir)


def on_events(spark, sf_dir, local, lookback=8, expanding=None, cols=()) -> DataFrame:
    """Sequence features over the events panel, with only the columns the query needs."""
    ev = events(spark, sf_dir).select("sid", "id", "ts", *cols)
    return P.sequence_features(ev, S.EVENTS, local, lookback, expanding)


@query("w1_timestep_index", with_sql(EVENTS_SQL, "SELECT id, CAST(row_number() OVER (PARTITION BY sid ORDER BY ts, id) - 1 AS INTEGER) AS timestep_index FROM ev"))
def w1(spark, sf_dir):
    return on_events(spark, sf_dir, None).select("id", "timestep_index")


@query(
    "w2_clock_flags",
    with_sql(EVENTS_SQL, f"""SELECT id, {sr('t / 24.0')} AS normalized_time, CAST(t < 5 AS INTEGER) AS cold_start_flag,
 CAST(t = 0 AS INTEGER) AS is_scenario_boundary FROM (SELECT id, row_number() OVER (PARTITION BY sid ORDER BY ts, id) - 1 AS t FROM ev)"""),
)
def w2(spark, sf_dir):
    out = on_events(spark, sf_dir, lambda d, w: d.select("id", "sid", "ts", *[c.alias(n) for n, c in P.clock_columns().items()]))
    return out.select("id", r("normalized_time").alias("normalized_time"), "cold_start_flag", "is_scenario_boundary")


@query(
    "w3_rolling_moments",
    with_sql(EVENTS_SQL, "SELECT id, " + ", ".join(
        f"{sr(f'coalesce(avg({c}) OVER r{n}, 0)')} AS {c}_rolling_mean_{n}, {sr(f'coalesce(stddev_samp({c}) OVER r{n}, 0)', 5)} AS {c}_rolling_std_{n}"
        for c in ("value", "k") for n in (3, 5)) + f" FROM ev {WIN}"),
)
def w3(spark, sf_dir):
    def local(d, w):
        cols = P.rolling_columns("value", w) | P.rolling_columns("k", w)
        return d.select("*", *[c.alias(n) for n, c in cols.items()])

    out = on_events(spark, sf_dir, local, 4, cols=("value", "k"))
    return out.select("id", *[
        r(f"{c}_rolling_{m}_{n}", 6 if m == "mean" else 5).alias(f"{c}_rolling_{m}_{n}") for c in ("value", "k") for n in (3, 5) for m in ("mean", "std")
    ])


FILL_SQL = {
    "n_lines": "0.0",
    "disc_avg": "coalesce(quantile_cont(disc_avg, 0.5) OVER past, 0.0)",
    "qty_avg": "coalesce(avg(qty_avg) OVER past, (SELECT avg(qty_avg) FROM op WHERE is_train), 0.0)",
}
TS_SQL = f"""
t1 AS (SELECT id, sid, odate, {', '.join(f'''{c}, coalesce({c}, {f}) AS {c}_f, coalesce(lag({c}) OVER w, {f}) AS {c}_lag,
  coalesce(avg({c}) OVER r5, 0.0) AS {c}_rm5''' for c, f in FILL_SQL.items())} FROM op {OWIN})"""


def typed_features(spark, sf_dir) -> DataFrame:
    op = S.order_panel(spark, sf_dir)
    means = {"qty_avg": op.where("is_train").agg(F.avg("qty_avg")).first()[0]}
    return P.time_series_features(op.select("id", "sid", "odate", *TYPES), S.ORDERS, TYPES, means)


@query("w4_w6_typed_lag_diff", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'{c}_f - {c}_lag')} AS {c}_diff_1" for c in TYPES) + " FROM t1", TS_SQL))
def w4(spark, sf_dir):
    return typed_features(spark, sf_dir).select("id", *[r(f"{c}_diff_1").alias(f"{c}_diff_1") for c in TYPES])


@query(
    "w5_causal_past_mean_median",
    with_sql(EVENTS_SQL, f"SELECT id, {sr('avg(value) OVER past')} AS past_mean, {sr('quantile_cont(value, 0.5) OVER past')} AS past_median FROM ev {WIN}"),
)
def w5(spark, sf_dir):
    e = {"past_mean": P.Expanding("mean", "value", True), "past_median": P.Expanding("median", "value", True)}
    out = on_events(spark, sf_dir, None, expanding=e, cols=("value",))
    return out.select("id", r("past_mean").alias("past_mean"), r("past_median").alias("past_median"))


@query(
    "w7_slope_5",
    with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(
        f"{sr(f'coalesce(({c}_rm5 - lag({c}_rm5, 4) OVER w) / 5.0, 0.0)')} AS {c}_slope_5" for c in TYPES) + " FROM t1 WINDOW w AS (PARTITION BY sid ORDER BY odate, id)", TS_SQL),
)
def w7(spark, sf_dir):
    return typed_features(spark, sf_dir).select("id", *[r(f"{c}_slope_5").alias(f"{c}_slope_5") for c in TYPES])


@query("w8_rate_1", with_sql(ORDERS_SQL, "SELECT id, " + ", ".join(f"{sr(f'({c}_f - {c}_lag) / (abs({c}_f) + 1.0)')} AS {c}_rate_1" for c in TYPES) + " FROM t1", TS_SQL))
def w8(spark, sf_dir):
    return typed_features(spark, sf_dir).select("id", *[r(f"{c}_rate_1").alias(f"{c}_rate_1") for c in TYPES])


@query(
    "w9_scenario_context",
    with_sql(EVENTS_SQL, f"SELECT id, {sr('max(value) OVER upto')} AS scenario_max_historic, {sr('coalesce(stddev_samp(value) OVER upto, 0)', 5)} AS scenario_volatility_causal FROM ev {WIN}"),
)
def w9(spark, sf_dir):
    e = {"scenario_max_historic": P.Expanding("max", "value"), "vol": P.Expanding("std", "value")}
    out = on_events(spark, sf_dir, None, expanding=e, cols=("value",))
    return out.select(
        "id", r("scenario_max_historic").alias("scenario_max_historic"), r(F.coalesce("vol", F.lit(0.0)), 5).alias("scenario_volatility_causal")
    )


@query(
    "w10_rel_to_mean_5",
    with_sql(EVENTS_SQL, f"""SELECT id, {sr('CASE WHEN abs(m) > 1.1920928955078125e-07 THEN (k - m) / (m + 1.1920928955078125e-07) ELSE 0.0 END')} AS k_rel_to_mean_5
 FROM (SELECT id, k, avg(k) OVER r5 AS m FROM ev {WIN})"""),
)
def w10(spark, sf_dir):
    out = on_events(spark, sf_dir, lambda d, w: d.withColumn("m", F.avg("k").over(P.back(w, 5))), 4, cols=("k",))
    return out.select("id", r(X.relative_to(F.col("k"), F.col("m"))).alias("k_rel_to_mean_5"))


@query(
    "w11_rolling_range_diff3",
    with_sql(EVENTS_SQL, f"""SELECT id, max(value) OVER r5 AS recent_max_5, min(value) OVER r5 AS recent_min_5,
 {sr('max(value) OVER r5 - min(value) OVER r5')} AS range_5, {sr('value - lag(value, 3) OVER w')} AS diff_3 FROM ev {WIN}"""),
)
def w11(spark, sf_dir):
    def local(d, w):
        f = P.back(w, 5)
        return d.select("*", F.max("value").over(f).alias("recent_max_5"), F.min("value").over(f).alias("recent_min_5"), F.lag("value", 3).over(w).alias("l3"))

    out = on_events(spark, sf_dir, local, 4, cols=("value",))
    return out.select("id", "recent_max_5", "recent_min_5", r(F.col("recent_max_5") - F.col("recent_min_5")).alias("range_5"), r(F.col("value") - F.col("l3")).alias("diff_3"))


@query(
    "w12_expanding_moments",
    with_sql(EVENTS_SQL, f"SELECT id, {sr('avg(value) OVER upto')} AS expanding_mean, {sr('sum(value) OVER upto', 4)} AS expanding_sum, {sr('stddev_samp(value) OVER upto', 5)} AS expanding_std FROM ev {WIN}"),
)
def w12(spark, sf_dir):
    e = {f"expanding_{k}": P.Expanding(k, "value") for k in ("mean", "sum", "std")}
    out = on_events(spark, sf_dir, None, expanding=e, cols=("value",))
    return out.select("id", r("expanding_mean").alias("expanding_mean"), r("expanding_sum", 4).alias("expanding_sum"), r("expanding_std", 5).alias("expanding_std"))


@query(
    "w13_rel_to_max_accel",
    with_sql(EVENTS_SQL, f"""SELECT id, {sr('value / (max(value) OVER r5 + 1e-6)')} AS rel_to_max_5,
 {sr('value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w')} AS accel FROM ev {WIN}"""),
)
def w13(spark, sf_dir):
    def local(d, w):
        return d.select("*", F.max("value").over(P.back(w, 5)).alias("m"), F.lag("value", 1).over(w).alias("l1"), F.lag("value", 2).over(w).alias("l2"))

    out = on_events(spark, sf_dir, local, 4, cols=("value",))
    return out.select("id", r(F.col("value") / (F.col("m") + 1e-6)).alias("rel_to_max_5"), r(F.col("value") - 2 * F.col("l1") + F.col("l2")).alias("accel"))


@query(
    "w14_rolling_rank_5",
    with_sql(EVENTS_SQL, f"""SELECT id, {sr("len(list_filter(a, lambda x: x < k)) + (len(list_filter(a, lambda x: x = k)) + 1) / 2.0")} AS rel_rank_5
 FROM (SELECT id, k, list(k) OVER r5 AS a FROM ev {WIN})"""),
)
def w14(spark, sf_dir):
    out = on_events(spark, sf_dir, lambda d, w: d.withColumn("a", F.collect_list("k").over(P.back(w, 5))), 4, cols=("k",))
    return out.select("id", r(P.rolling_rank(F.col("a"), F.col("k")) * F.size("a")).alias("rel_rank_5"))


@query(
    "w15_volatility_expansion",
    with_sql(EVENTS_SQL, f"""SELECT id, {sr('stddev_samp(value) OVER r3 / (stddev_samp(value) OVER r10 + 1e-6)', 5)} AS volatility_expansion_std,
 {sr('(max(value) OVER r3 - min(value) OVER r3) / (max(value) OVER r10 - min(value) OVER r10 + 1e-6)')} AS volatility_expansion_range FROM ev {WIN}"""),
)
def w15(spark, sf_dir):
    def local(d, w):
        a, b = P.back(w, 3), P.back(w, 10)
        return d.select(
            "*",
            *[F.stddev_samp("value").over(x).alias(f"s{n}") for n, x in ((3, a), (10, b))],
            *[(F.max("value").over(x) - F.min("value").over(x)).alias(f"g{n}") for n, x in ((3, a), (10, b))],
        )

    out = on_events(spark, sf_dir, local, 9, cols=("value",))
    return out.select("id", r(F.col("s3") / (F.col("s10") + 1e-6), 5).alias("volatility_expansion_std"), r(F.col("g3") / (F.col("g10") + 1e-6)).alias("volatility_expansion_range"))


@query(
    "w16_count_above_own_q75",
    with_sql(EVENTS_SQL, f"""SELECT id, CAST(len(list_filter(a, lambda x: x > q)) AS INTEGER) AS consecutive_above_q75
 FROM (SELECT id, list(k) OVER r5 AS a, quantile_cont(k, 0.75) OVER r5 AS q FROM ev {WIN})"""),
)
def w16(spark, sf_dir):
    def local(d, w):
        f = P.back(w, 5)
        return d.select("*", F.collect_list("k").over(f).alias("a"), F.percentile("k", F.lit(0.75)).over(f).alias("q"))

    out = on_events(spark, sf_dir, local, 4, cols=("k",))
    return out.select("id", F.size(F.filter("a", lambda x: x > F.col("q"))).alias("consecutive_above_q75"))


def quintile_sql(c: str, src: str) -> str:
    return f"(SELECT {', '.join(f'quantile_cont({c}, {q}) AS q{i}' for i, q in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))} FROM {src}) e"


@query(
    "w17_quintile_regime",
    with_sql(EVENTS_SQL, f"SELECT id, CAST((value > q1)::INT + (value > q2)::INT + (value > q3)::INT + (value > q4)::INT AS INTEGER) AS regime_id FROM ev, {quintile_sql('value', 'ev')}"),
)
def w17(spark, sf_dir):
    ev = events(spark, sf_dir)
    edges = fit_quantiles(ev, {"value": (F.col("value"), [0, 0.2, 0.4, 0.6, 0.8, 1.0])})["value"]
    return ev.select("id", X.right_closed_bin(F.col("value"), edges).alias("regime_id"))


@query(
    "w18_percent_rank_ties",
    with_sql(PRED_SQL, f"""SELECT id, {sr('(rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER ()')} AS rank_asc,
 {sr('(rank() OVER (ORDER BY p DESC) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER ()')} AS rank_desc FROM pp"""),
)
def w18(spark, sf_dir):
    ranked = ranks.tie_ranks(S.pred_panel(spark, sf_dir).select("id", "p"), [], "p", "k")
    return ranked.select("id", r(F.col("k") / F.col("k_n")).alias("rank_asc"), r((F.col("k_n") + 1 - F.col("k")) / F.col("k_n")).alias("rank_desc"))


@query(
    "w19_rank_vs_train_reference",
    with_sql(EVENTS_SQL, f"""SELECT e.id, {sr('coalesce(c.below, 0) * 1.0 / ((SELECT count(*) FROM ev WHERE is_train) + 1)')} AS train_rank
 FROM ev e LEFT JOIN (SELECT v, sum(r) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
  FROM (SELECT value AS v, sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS r FROM ev GROUP BY 1)) c ON c.v = e.value"""),
)
def w19(spark, sf_dir):
    ev = events(spark, sf_dir).select("id", "value", "is_train")
    out = ranks.rank_against_reference(ev, ev.where("is_train"), "value", "train_rank")
    return out.select("id", r("train_rank").alias("train_rank"))


@query("w22_interleaved_scenarios", with_sql(ORDERS_SQL, """SELECT CAST(count(*) AS BIGINT) AS n_scenarios, CAST(count_if(lo < prev) AS BIGINT) AS overlaps,
 round(1.0 - count_if(lo < prev) * 1.0 / count(*), 6)::DOUBLE AS consistency_score FROM (SELECT lo, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
 FROM (SELECT sid, min(id) AS lo, max(id) AS hi FROM op GROUP BY 1))"""))
def w22(spark, sf_dir):
    return interleaving(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("id")))


@query("w22_contiguous_scenarios", with_sql(BLOCKS_SQL, """SELECT CAST(count(*) AS BIGINT) AS n_scenarios, CAST(count_if(lo < prev) AS BIGINT) AS overlaps,
 round(1.0 - count_if(lo < prev) * 1.0 / count(*), 6)::DOUBLE AS consistency_score FROM (SELECT lo, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
 FROM (SELECT sid, min(id) AS lo, max(id) AS hi FROM bp GROUP BY 1))"""))
def w22b(spark, sf_dir):
    return interleaving(S.block_panel(spark, sf_dir).select("sid", "id"))


def interleaving(rows: DataFrame) -> DataFrame:
    """How many sequences start before an earlier-starting one has ended."""
    spans = rows.groupBy("sid").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    run = prefix_scan(spans, [], ["lo"], before=["hi"])
    late = F.count_if(F.col("lo") < F.col("before_hi"))
    return run.agg(F.count(F.lit(1)).alias("n_scenarios"), late.alias("overlaps"), r(1.0 - late / F.count(F.lit(1))).alias("consistency_score"))


@query("w23_monotonic_order", with_sql(ORDERS_SQL, """SELECT sid, coalesce(bool_or(id < prev), false) AS is_unordered, CAST(coalesce(count_if(id < prev), 0) AS BIGINT) AS n_steps_back
 FROM (SELECT sid, id, lag(id) OVER (PARTITION BY sid ORDER BY odate, id) AS prev FROM op) GROUP BY 1"""))
def w23(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("odate"))
    out = P.sequence_features(o, S.ORDERS, lambda d, w: d.withColumn("prev", F.lag("id").over(w)), 1)
    back = F.col("id") < F.col("prev")
    return out.groupBy("sid").agg(F.coalesce(F.bool_or(back), F.lit(False)).alias("is_unordered"), F.count_if(back).alias("n_steps_back"))


@query("w24_label_flip_rate", with_sql(ORDERS_SQL, f"""SELECT CAST(count(*) AS BIGINT) AS n_pairs, {sr('avg(CASE WHEN lab <> prev THEN 1.0 ELSE 0.0 END)')} AS flip_rate FROM
 (SELECT lab, lag(lab) OVER (PARTITION BY sid ORDER BY odate, id) AS prev FROM (SELECT *, y >= (SELECT quantile_cont(y, 0.9) FROM op) AS lab FROM op)) WHERE prev IS NOT NULL"""))
def w24(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("odate"), F.col("o_totalprice").alias("y"))
    q90 = fit_quantiles(o, {"y": (F.col("y"), [0.9])})["y"][0]
    out = P.sequence_features(o.withColumn("lab", F.col("y") >= q90), S.ORDERS, lambda d, w: d.withColumn("prev", F.lag("lab").over(w)), 1)
    pairs = out.where(F.col("prev").isNotNull())
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), r(F.avg((F.col("lab") != F.col("prev")).cast("double"))).alias("flip_rate"))


DECILES = [i / 10 for i in range(11)]


def decile_sql(c: str, src: str) -> str:
    return f"(SELECT {', '.join(f'quantile_cont({c}, {q / 10}) AS d{q}' for q in range(11))} FROM {src}) e"


def decile_of(c: str) -> str:
    return "CAST(" + " + ".join(f"({c} > d{i})::INT" for i in range(1, 10)) + " AS INTEGER)"


@query("w25_deciles", with_sql(PRED_SQL, f"""SELECT by_id, by_y, CAST(count(*) AS BIGINT) AS n, {sr('avg(y)', 3)} AS mean_y FROM
 (SELECT y, {decile_of('id')} AS by_id, by_y FROM (SELECT id, y, {decile_of('y')} AS by_y FROM pp, {decile_sql('y', 'pp')}) x, {decile_sql('id', 'pp')}) GROUP BY 1, 2"""))
def w25(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))
    edges = fit_quantiles(o, {"id": (F.col("id"), DECILES), "y": (F.col("y"), DECILES)})
    cells = o.groupBy(X.right_closed_bin(F.col("id"), edges["id"]).alias("by_id"), X.right_closed_bin(F.col("y"), edges["y"]).alias("by_y"))
    return cells.agg(F.count(F.lit(1)).alias("n"), r(F.avg("y"), 3).alias("mean_y"))


TRACE = ("rolling_mean_3", "rolling_std_3", "diff_1", "diff_3", "recent_max_5", "expanding_std", "accel")
TRACE_SQL = {
    "rolling_mean_3": "avg({c}) OVER r3", "rolling_std_3": "stddev_samp({c}) OVER r3", "diff_1": "{c} - lag({c}) OVER w",
    "diff_3": "{c} - lag({c}, 3) OVER w", "recent_max_5": "max({c}) OVER r5", "expanding_std": "stddev_samp({c}) OVER upto",
    "accel": "{c} - 2 * lag({c}) OVER w + lag({c}, 2) OVER w",
}


@query(
    "w26_nan_trace",
    with_sql(ORDERS_SQL, f"""SELECT feature, suffix, {sr('nan_pct')} AS nan_pct, {sr('avg(nan_pct) OVER (PARTITION BY suffix)')} AS suffix_mean FROM (
 SELECT feature, split_part(feature, '__', 2) AS suffix, nan_pct FROM (UNPIVOT (SELECT {', '.join(f'avg(CASE WHEN {c}__{s} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}__{s}' for c in S.SENSORS for s in TRACE)}
 FROM tr) ON COLUMNS(*) INTO NAME feature VALUE nan_pct)) ORDER BY nan_pct DESC, feature LIMIT 20""",
        f"tr AS (SELECT {', '.join(TRACE_SQL[s].format(c=c) + f' AS {c}__{s}' for c in S.SENSORS for s in TRACE)} FROM op {OWIN})"),
)
def w26(spark, sf_dir):
    cols = S.SENSORS
    expanding = {f"{c}__expanding_std": P.Expanding("std", c) for c in cols}

    def local(d, w):
        new = {}
        for c in cols:
            x, l1, l2 = F.col(c), F.lag(c, 1).over(w), F.lag(c, 2).over(w)
            new |= {
                f"{c}__rolling_mean_3": F.avg(c).over(P.back(w, 3)),
                f"{c}__rolling_std_3": F.stddev_samp(c).over(P.back(w, 3)),
                f"{c}__diff_1": x - l1,
                f"{c}__diff_3": x - F.lag(c, 3).over(w),
                f"{c}__recent_max_5": F.max(c).over(P.back(w, 5)),
                f"{c}__accel": x - 2 * l1 + l2,
            }
        return d.select("*", *[v.alias(k) for k, v in new.items()])

    op = S.order_panel(spark, sf_dir).select("id", "sid", "odate", *cols)
    feats = P.sequence_features(op, S.ORDERS, local, 4, expanding)
    names = [f"{c}__{s}" for c in cols for s in TRACE]
    rates = drift.stats_long(feats, names, nan_pct=lambda c: F.avg(c.isNull().cast("double")))
    rates = rates.withColumn("suffix", F.substring_index("feature", "__", -1))
    out = rates.withColumn("suffix_mean", F.avg("nan_pct").over(W.partitionBy("suffix")))
    return out.orderBy(F.desc("nan_pct"), "feature").limit(20).select("feature", "suffix", r("nan_pct").alias("nan_pct"), r("suffix_mean").alias("suffix_mean"))
