"""Scan, sink, registry and schema queries.  What is written is read back before it is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import exprs as X
from panelforge.operators import drift, features as FE, panel as P, selection as SE, tables as TB
from panelforge.plans.drift_audit import BASE, sensor_ks
from panelforge.plans.features import NAMED, PAIRS, named_features
from panelforge.plans.registry import EVENTS_SQL, ORDERS_SQL, PRED_SQL, query, r, sr, with_sql
from panelforge.plans.selection import G_BASE, LINEAGE, gated
from panelforge.sources import files as IO, panels as S


@query("s1_load_fact_with_layout", "SELECT o_orderkey AS id, o_custkey AS sid, o_totalprice AS target, c_nationkey AS layout, c_mktsegment AS layout_type FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def s1(spark, sf_dir):
    """Both inputs as CSV with a stated schema, the target renamed, the layout attached."""
    base = IO.run_folder(spark)
    IO.write_csv(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sid"), "o_totalprice"), f"{base}/fact")
    IO.write_csv(S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_nationkey").alias("layout"), F.col("c_mktsegment").alias("layout_type")), f"{base}/layout")
    fact = IO.read_csv(spark, f"{base}/fact", "id bigint, sid bigint, o_totalprice double")
    layout = IO.read_csv(spark, f"{base}/layout", "sid bigint, layout int, layout_type string")
    return IO.load_panel(fact, layout, "sid", ("o_totalprice", "target")).select("id", "sid", "target", "layout", "layout_type")


@query("s2_short_run_scan", with_sql(EVENTS_SQL, "SELECT id, sid, value FROM ev ORDER BY id LIMIT 500"))
def s2(spark, sf_dir):
    return IO.first_rows(S.events_panel(spark, sf_dir).select("id", "sid", "value"), "id", 500)


@query("s3_downcast", """SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey, CAST(l_suppkey AS INTEGER) AS l_suppkey, l_linenumber,
 CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_discount AS FLOAT) AS l_discount, CAST(l_tax AS FLOAT) AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""")
def s3(spark, sf_dir):
    return IO.downcast(S.table(spark, sf_dir, "lineitem"))


@query("s4_feature_table_round_trip", with_sql(ORDERS_SQL, "SELECT id, is_train, qty_sum, disc_avg FROM op WHERE is_train"))
def s4(spark, sf_dir):
    path = f"{IO.run_folder(spark)}/features"
    op = S.order_panel(spark, sf_dir).select("id", "is_train", "qty_sum", "disc_avg")
    IO.save_table(op.where("is_train"), path, "train")
    IO.save_table(op.where("NOT is_train"), path, "test")
    return IO.load_table(spark, path, "train")


@query("s5_prediction_table_round_trip", with_sql(PRED_SQL, "SELECT id, fold, oof FROM pp"))
def s5(spark, sf_dir):
    path = f"{IO.run_folder(spark)}/oof"
    IO.save_table(S.pred_panel(spark, sf_dir).select("id", "fold", "oof"), path, "run")
    return IO.load_table(spark, path, "run")


@query("s6_manifest_round_trip")
def s6(spark, sf_dir):
    """Training decisions saved as one JSON row and read back for the test side."""
    op = S.order_panel(spark, sf_dir)
    train = op.where("is_train")
    m = SE.Manifest(
        train_means=drift_means(train), bin_edges=FE.fit_bin_edges(train, ["qty_sum"]), kinds=TB.fit_kinds(train, S.SENSORS)
    )
    path = f"{IO.run_folder(spark)}/manifest"
    spark.createDataFrame([(m.train_means, m.bin_edges, m.kinds)], "train_means map<string,double>, bin_edges map<string,array<double>>, kinds map<string,string>").write.json(path)
    back = spark.read.schema("train_means map<string,double>, bin_edges map<string,array<double>>, kinds map<string,string>").json(path)
    return back.select(F.explode("train_means").alias("feature", "train_mean"), "kinds").select("feature", "train_mean", F.col("kinds")[F.col("feature")].alias("kind"))


def drift_means(train) -> dict[str, float]:
    return train.agg(*[F.avg(c).alias(c) for c in S.SENSORS]).first().asDict()


@query("s7_drift_report_csv", with_sql(ORDERS_SQL, f"SELECT feature, {sr('ks_stat')} AS ks_stat, ks_stat > 0.01 AS is_drifted FROM ks", *BASE))
def s7(spark, sf_dir):
    path = f"{IO.run_folder(spark)}/drift"
    IO.write_csv(sensor_ks(spark, sf_dir).select("feature", r("ks_stat").alias("ks_stat"), (F.col("ks_stat") > 0.01).alias("is_drifted")), path)
    return IO.read_csv(spark, path, "feature string, ks_stat double, is_drifted boolean")


@query("s8_build_submission", with_sql(PRED_SQL, "SELECT id, greatest(round_even(coalesce(oof, nt) / 1000.0 - 50, 3), 0.0) AS pred FROM pp"))
def s8(spark, sf_dir):
    preds = S.pred_panel(spark, sf_dir).select("id", (F.coalesce("oof", "nt") / 1000.0 - 50).alias("pred"))
    path = f"{IO.run_folder(spark)}/submission"
    IO.write_csv(IO.build_submission(preds), path)
    return IO.read_csv(spark, path, "id bigint, pred double")


@query("s9_validate_submission", with_sql(PRED_SQL, """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(oof IS NULL) AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_infinite, CAST(count_if(oof < 0) AS BIGINT) AS n_negative, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_missing,
 CAST(0 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_repeated FROM pp WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""))
def s9(spark, sf_dir):
    """A submission that leaves out the finished orders and holds NULLs must be reported as such."""
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    sub = S.pred_panel(spark, sf_dir).select("id", F.col("oof").alias("pred")).join(o.where("o_orderstatus <> 'F'").select("id"), "id", "left_semi")
    return IO.submission_errors(sub, o.select("id"))


@query("s9_submission_layout", """SELECT '' AS missing_columns, 'note' AS extra_columns, 'pred' AS retyped_columns, CAST(count_if(a <> b) AS BIGINT) AS n_moved FROM
 (SELECT row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderkey) AS b FROM orders)""")
def s9_layout(spark, sf_dir):
    """A written submission whose finished orders stand last, with a column too many and another type, read beside the sample file."""
    o, folder = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("pred"), (F.col("o_orderstatus") == "F").alias("late")), IO.run_folder(spark)
    IO.write_csv(o.orderBy("id").drop("late"), f"{folder}/sample")
    IO.write_csv(o.orderBy("late", "id").select("id", "pred", F.lit("x").alias("note")), f"{folder}/submission")
    return IO.submission_layout_errors(IO.read_csv(spark, f"{folder}/submission", "id bigint, pred float, note string"), IO.read_csv(spark, f"{folder}/sample", "id bigint, pred double"))


@query("s10_table_fingerprint")
def s10(spark, sf_dir):
    return TB.fingerprint(S.table(spark, sf_dir, "orders"))


RUNS = "(SELECT 'run_' || (o_custkey % 40) AS run_id, epoch(o_orderdate)::BIGINT * 100000 + o_orderkey AS ts, o_totalprice AS mae, CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' ELSE 'RISKY' END AS status FROM orders)"


def run_log(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("run_"), (F.col("o_custkey") % 40).cast("string")).alias("run_id"),
        (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 86400 * 100000 + F.col("o_orderkey")).alias("ts"),
        F.col("o_totalprice").alias("mae"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("RISKY").alias("status"),
    )


@query("s11_run_registry_upsert", f"SELECT run_id, arg_max(mae, ts) AS mae, arg_max(status, ts) AS status, max(ts) AS ts FROM {RUNS} GROUP BY 1")
def s11(spark, sf_dir):
    log = run_log(spark, sf_dir)
    late = F.col("mae") >= 250000
    return IO.upsert_runs(log.where(~late), log.where(late)).select("run_id", "mae", "status", "ts")


@query("s11_best_approved_run", f"SELECT arg_min(run_id, mae) AS run_id, min(mae) AS mae FROM (SELECT run_id, arg_max(mae, ts) AS mae, arg_max(status, ts) AS status FROM {RUNS} GROUP BY 1) WHERE status = 'APPROVED'")
def s11b(spark, sf_dir):
    log = run_log(spark, sf_dir)
    late = F.col("mae") >= 250000
    return IO.best_run(IO.upsert_runs(log.where(~late), log.where(late)))


@query("s12_audit_history", f"SELECT run_id, ts, mae FROM {RUNS} ORDER BY ts DESC LIMIT 100")
def s12(spark, sf_dir):
    log = run_log(spark, sf_dir).select("run_id", "ts", "mae")
    return IO.append_history(log.where("mae < 250000"), log.where("mae >= 250000"))


@query("s13_nested_registry_json", f"SELECT 'r' || sid AS run_id, {sr('avg(y)', 3)} AS mae, CAST(CASE sid % 3 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS n_folds, {sr('CASE sid % 3 WHEN 0 THEN (min(y) + max(y)) / 2 WHEN 1 THEN (min(y) + avg(y)) / 2 ELSE max(y) END', 3)} AS fold_mean FROM (SELECT o_custkey AS sid, o_totalprice AS y FROM orders) GROUP BY sid")
def s13(spark, sf_dir):
    """Documents of nested run records, with the three shapes fold statistics have had, written and parsed back."""
    g = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid")).agg(F.avg("o_totalprice").alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    obj = lambda f, m: F.concat(F.lit('{"fold": '), F.lit(str(f)), F.lit(', "mae": '), m.cast("string"), F.lit("}"))
    objects = F.concat(F.lit("["), obj(0, F.col("lo")), F.lit(", "), obj(1, F.col("hi")), F.lit("]"))
    numbers = F.concat(F.lit("["), F.col("lo").cast("string"), F.lit(", "), F.col("a").cast("string"), F.lit("]"))
    single = F.concat(F.lit('{"mean": '), F.col("hi").cast("string"), F.lit("}"))
    stats = F.when(F.col("sid") % 3 == 0, objects).when(F.col("sid") % 3 == 1, numbers).otherwise(single)
    metric = F.when(F.col("sid") % 3 == 0, F.concat(F.lit('"mean_mae": '), F.col("a").cast("string"))).otherwise(F.concat(F.lit('"metrics": {"mae": '), F.col("a").cast("string"), F.lit("}")))
    doc = F.concat(F.lit('{"runs": [{"run_id": "r'), F.col("sid").cast("string"), F.lit('", '), metric, F.lit(', "fold_stats": '), stats, F.lit("}]}"))
    path = f"{IO.run_folder(spark)}/registry"
    g.select(doc.alias("value")).write.text(path)
    return IO.runs_from_json(spark, path, one_per_line=True).select("run_id", r("mae", 3).alias("mae"), "n_folds", r("fold_mean", 3).alias("fold_mean"))


@query("s14_validation_log_json", with_sql(ORDERS_SQL, f"SELECT feature, {sr('gain', 4)} AS gain, passed, CAST(len(rejection_reasons) AS INTEGER) AS n_reasons FROM gg", *G_BASE))
def s14(spark, sf_dir):
    path = f"{IO.run_folder(spark)}/validation"
    gated(spark, sf_dir).select(F.array(F.struct("feature", "gain", "passed", "rejection_reasons")).alias("val_logs")).write.json(path)
    logs = spark.read.schema("val_logs array<struct<feature:string,gain:double,passed:boolean,rejection_reasons:array<string>>>").json(path)
    return logs.select(F.inline("val_logs")).select("feature", r("gain", 4).alias("gain"), "passed", F.size("rejection_reasons").alias("n_reasons"))


@query("s15_case_log_explode", with_sql(PRED_SQL, "SELECT fold, p, w, gap, t, nt, y FROM pp"))
def s15(spark, sf_dir):
    """Per-fold case logs hold parallel arrays; here one record per fold and 256 ids, so arrays stay short."""
    cols = ["p", "w", "gap", "t", "nt", "y"]
    pp = S.pred_panel(spark, sf_dir).withColumn("part", F.floor(F.col("id") / 256))
    packed = pp.groupBy("fold", "part").agg(F.array_sort(F.collect_list(F.struct("id", *cols))).alias("c"))
    logs = packed.select("fold", *[F.col(f"c.{n}").alias(n) for n in cols])
    return IO.explode_cases(logs, cols)


@query("s16_stage_contract", with_sql(ORDERS_SQL, "SELECT id, sid, y FROM op"))
def s16(spark, sf_dir):
    return IO.require(S.order_panel(spark, sf_dir), ["id", "sid", "y", *S.SENSORS], "drift audit").select("id", "sid", "y")


# --- schema and column-list operators -----------------------------------------------------------------------------


@query("p2_generated_feature_schema")
def p2(spark, sf_dir):
    """Every column the generated schema names, in its order."""
    feats = P.time_series_features(S.events_panel(spark, sf_dir), S.EVENTS, {"value": "sensor", "k": "count"}, {"value": 0.0})
    return SE.sync_schema(feats, P.feature_names(["value", "k"]), ["id", "sid", "ts", "event_type", "is_train"]).drop("ts", "event_type")


@query("p3_schema_sync_report")
def p3(spark, sf_dir):
    """Expected, missing and extra columns of a runtime frame, with how many values each one holds."""
    wide = named_features(spark, sf_dir)
    expected = {*NAMED, "qty_sum_slope_5"}
    have = set(wide.columns) - {"id", "sid", "odate", "layout", "ltype", "is_train", "y", "timestep_index"}
    counts = drift.stats_long(wide, sorted(have), n_values=lambda c: F.count(c))
    rows = [(c, "missing" if c not in have else "extra" if c not in expected else "matched") for c in sorted(have | expected)]
    return spark.createDataFrame(rows, "feature string, status string").join(counts, "feature", "left").fillna(0, ["n_values"])


def common_numeric(a, b, ids=()) -> list[str]:
    """Columns both frames hold as numbers, ids left out."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    other = {c for c, t in b.dtypes if t in numeric}
    return [c for c, t in a.dtypes if t in numeric and c in other and c not in set(ids)]


@query("p5_common_numeric_columns", with_sql(ORDERS_SQL, "SELECT feature, n FROM (UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c in S.SENSORS) + " FROM op WHERE is_train) ON COLUMNS(*) INTO NAME feature VALUE n)"))
def p5(spark, sf_dir):
    op = S.order_panel(spark, sf_dir)
    train, test = op.where("is_train"), op.where("NOT is_train").drop("y")
    cols = common_numeric(train, test, ["id", "sid", "layout", "ltype"])
    return drift.stats_long(train, cols, n=lambda c: F.count(c))


@query("p10_model_column_quarantine")
def p10(spark, sf_dir):
    """The columns each model may see: the classifier without its poison list, the tail model without its own."""
    wide = named_features(spark, sf_dir)
    lists = {"classifier": [c for c in NAMED if c not in ("n_lines", "qty_sum_rolling_std_3")], "tail": [c for c in NAMED if c not in ("qty_max",)], "bulk": NAMED}
    counts = drift.stats_long(wide, NAMED, n=lambda c: F.count(c))
    rows = [(m, c) for m, cs in lists.items() for c in cs]
    return spark.createDataFrame(rows, "model string, feature string").join(counts, "feature")


P11_SQL = ", ".join(f"{sr(f'{a} * {b}', 4)} AS inter_{a}_x_{b}, {sr(f'{a} / ({b} + 1e-9)', 3)} AS ratio_{a}_to_{b}" for a, b in PAIRS)


@query("p11_feature_group_selection", with_sql(ORDERS_SQL, f"SELECT id, {', '.join(S.SENSORS)}, {P11_SQL} FROM op"))
def p11(spark, sf_dir):
    """The full group: the base sensors, their ratios (the ratio group) and their products."""
    wide = named_features(spark, sf_dir)
    groups = {"base": list(S.SENSORS), "ratio": [c for c in NAMED if c.startswith("ratio_")], "inter": [c for c in NAMED if c.startswith("inter_")]}
    return wide.select("id", *groups["base"], *[r(c, 3).alias(c) for c in groups["ratio"]], *[r(c, 4).alias(c) for c in groups["inter"]])


@query("p13_column_lineage", with_sql(ORDERS_SQL, "SELECT child, parent, n AS n_values FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in LINEAGE) + ") l(child, parent) JOIN (UNPIVOT (SELECT " + ", ".join(f"count({c}) AS {c}" for c in S.SENSORS) + " FROM op) ON COLUMNS(*) INTO NAME parent VALUE n) USING (parent)"))
def p13(spark, sf_dir):
    counts = drift.stats_long(S.order_panel(spark, sf_dir), S.SENSORS, n_values=lambda c: F.count(c)).withColumnRenamed("feature", "parent")
    return spark.createDataFrame(LINEAGE, "child string, parent string").join(counts, "parent").select("child", "parent", "n_values")
