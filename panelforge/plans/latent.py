"""Embedding, neighbour and cluster queries."""

from __future__ import annotations

from functools import partial
from uuid import uuid4

from pyspark.sql import functions as F

from panelforge.functions import exprs as X
from panelforge.operators import embedding as EM, features as FE, latents as LT, metrics as M, neighbours as NB, splits as SP
from panelforge.operators.quantiles import fit_quantiles
from panelforge.operators.selection import sync_schema
from panelforge.operators.side_by_side import side_by_side
from panelforge.plans.aggregates import SCEN_SQL, TAIL_SQL, scenario_report, tailed
from panelforge.plans.registry import ORDERS_SQL, PRED_SQL, query, r, sr, with_sql
from panelforge.session import cut_lineage, ensure_checkpoint_dir, stored
from panelforge.sources import panels as S

VEC_SQL = """vv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
vu AS (SELECT id, label, v, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda z: z * z))) + 1e-8)) AS u FROM vv)"""


def edge_sql(targets: str, pool: str, k: int, name: str = "ed") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.id, b.id AS nid, round(1 - list_dot_product(a.u, b.u), 9) + 0.0 AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_dot_product(a.u, b.u), 9), b.id) AS pos
 FROM vu a JOIN vu b ON {targets} AND {pool} AND a.id <> b.id) WHERE pos <= {k})"""


LATENT_FOLDS = 3
ALL = ("true", "true")  # every vector among all others


@query("e8_cosine_neighbours", "WITH " + VEC_SQL + ",\n" + edge_sql(*ALL, 40) + f" SELECT id, nid, {sr('distance')} AS distance, CAST(pos AS INTEGER) AS pos, pos <= 10 AS in_10, pos <= 20 AS in_20 FROM ed")
def e8(spark, sf_dir):
    """The 40 nearest of every vector, and which of them are among the nearest 10 and 20."""
    v = S.vectors(spark, sf_dir)
    return NB.nearest(v, v, 40, exclude_self=True).select("id", "nid", r("distance").alias("distance"), "pos", (F.col("pos") <= 10).alias("in_10"), (F.col("pos") <= 20).alias("in_20"))


@query("e8_self_excluded_neighbours", "WITH " + VEC_SQL + ",\n" + edge_sql("true", "true", 10) + f" SELECT id, nid, {sr('distance')} AS distance, CAST(pos AS INTEGER) AS pos FROM ed")
def e8b(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    return EM.fold_neighbours(v, v, 10, is_train=True).select("id", "nid", r("distance").alias("distance"), "pos")


@query("e9_neighbour_statistics", "WITH " + VEC_SQL + ",\n" + edge_sql(*ALL, 20) + f"""SELECT id, CAST(d - 1 AS INTEGER) AS dim, {sr('avg(x)')} AS embed_mean, {sr('stddev_pop(x)', 5)} AS embed_std, {sr('sum(w * x) / sum(w)')} AS weighted_mean, {sr('avg(x) - any_value(own)')} AS trend_proxy FROM
 (SELECT ed.id, d, p.v[d] AS x, t.v[d] AS own, exp(1 - greatest(distance, 1e-6)) AS w FROM ed JOIN vv p ON p.id = ed.nid JOIN vv t ON t.id = ed.id JOIN (SELECT unnest(range(1, 65)) AS d) g ON true) GROUP BY 1, 2""")
def e9(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    g = NB.neighbourhoods(v, v, (20,), exclude_self=True)
    names = {"embed_mean": 6, "embed_std": 5, "weighted_mean": 6, "trend_proxy": 6}
    z = g.select("id", F.posexplode(F.arrays_zip(*[F.col(f"{n}_20").alias(n) for n in names])).alias("dim", "z"))
    return z.select("id", "dim", *[r(F.col(f"z.{n}"), d).alias(n) for n, d in names.items()])


@query("e11_density_entropy", "WITH " + VEC_SQL + ",\n" + edge_sql(*ALL, 40) + f"""SELECT id, {sr('1 / (avg(d) FILTER (pos <= 20) + 1e-6)', 5)} AS local_density, {sr('-sum(w / s * ln(w / s + 1e-8))')} AS similarity_entropy FROM (SELECT *, sum(w) OVER (PARTITION BY id) AS s FROM (SELECT id, pos, greatest(distance, 1e-6) AS d, exp(1 - greatest(distance, 1e-6)) AS w FROM ed)) GROUP BY 1""")
def e11(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    g = NB.neighbourhoods(v, v, (40,), exclude_self=True)
    return g.select("id", r("local_density", 5).alias("local_density"), r("similarity_entropy").alias("similarity_entropy"))


@query("j11_top_k_similarity_join", "WITH " + VEC_SQL + ",\n" + edge_sql(*ALL, 3) + f" SELECT ed.id, nid, t.label AS label, p.label AS neighbour_label, {sr('1 - distance')} AS similarity FROM ed JOIN vv t ON t.id = ed.id JOIN vv p ON p.id = ed.nid")
def j11(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    e = NB.nearest(v, v, 3, exclude_self=True)
    out = e.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("nid"), F.col("label").alias("neighbour_label")), "nid")
    return out.select("id", "nid", "label", "neighbour_label", r(1.0 - F.col("distance")).alias("similarity"))


@query("j12_neighbour_labels", "WITH " + VEC_SQL + ",\n" + edge_sql("true", "true", 5) + f" SELECT ed.id, {sr('avg((p.label >= 8)::INT)')} AS share, {sr('stddev_pop((p.label >= 8)::INT)', 5)} AS spread FROM ed JOIN vv p ON p.id = ed.nid GROUP BY 1")
def j12(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    labels = v.select("id", (F.col("label") >= 8).cast("int").alias("l"))
    return NB.label_consistency(NB.nearest(v, v, 5, exclude_self=True), labels, "l").select("id", r("share").alias("share"), r("spread", 5).alias("spread"))


@query("e14_label_noise_ratio", "WITH " + VEC_SQL + ",\n" + edge_sql("true", "true", 10) + f" SELECT {sr('avg((s > 0.3)::INT)')} AS noise_ratio, {sr('avg((s < 0.1)::INT)')} AS consistent_share, CAST(count(*) AS BIGINT) AS n FROM (SELECT ed.id, round(stddev_pop((p.label >= 8)::INT), 9) AS s FROM ed JOIN vv p ON p.id = ed.nid GROUP BY 1)")
def e14(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    c = NB.label_consistency(NB.nearest(v, v, 10, exclude_self=True), v.select("id", (F.col("label") >= 8).cast("int").alias("l")), "l")
    spread = F.round("spread", 9)
    return c.agg(r(F.avg((spread > 0.3).cast("double"))).alias("noise_ratio"), r(F.avg((spread < 0.1).cast("double"))).alias("consistent_share"), F.count(F.lit(1)).alias("n"))


@query("m34_neighbour_rescue", "WITH " + VEC_SQL + ",\n" + edge_sql("true", "true", 5) + f"""SELECT c.id, share >= 0.4 AND p <= 0.4 AS rescued, {sr('CASE WHEN share >= 0.4 AND p <= 0.4 THEN 1.0 ELSE p * p END')} AS weight, {sr('1 / (1 + exp(-15 * (p - 0.25)))')} AS sharp_boost, {sr('sqrt(p)')} AS amplified
 FROM (SELECT ed.id, avg((v.label >= 8)::INT) AS share, ((ed.id * 37) % 101) / 100.0 AS p FROM ed JOIN vv v ON v.id = ed.nid GROUP BY 1) c""")
def m34(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    c = NB.label_consistency(NB.nearest(v, v, 5, exclude_self=True), v.select("id", (F.col("label") >= 8).cast("int").alias("l")), "l")
    p = ((F.col("id") * 37) % 101) / 100.0
    hit = (F.col("share") >= 0.4) & (p <= 0.4)
    return c.select("id", hit.alias("rescued"), r(F.when(hit, 1.0).otherwise(p * p)).alias("weight"), r(1.0 / (1.0 + F.exp(-15.0 * (p - 0.25)))).alias("sharp_boost"), r(F.sqrt(p)).alias("amplified"))


SENSORS = list(S.SENSORS)
LAY_SCALE = "ls AS (SELECT id, layout, is_train, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}, (coalesce({c}, m_{c}) - m_{c}) / s_{c} AS z_{c}" for c in SENSORS) + " FROM op, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SENSORS) + " FROM op WHERE is_train))"
LAY_DISTANCE = "round(sqrt(" + " + ".join(f"(t.z_{c} - p.z_{c}) ^ 2" for c in SENSORS) + "), 6) + 0.0"
NEAR_STATS = {"mean": ("avg", 4), "std": ("stddev_pop", 3), "min": ("min", 6), "max": ("max", 6)}


@query("e13_layout_neighbours", with_sql(ORDERS_SQL, "SELECT id, any_value(is_train) AS is_train, CAST(count(*) AS BIGINT) AS n_neighbours, " + f"{sr('avg(distance)', 5)} AS knn_dist_mean, {sr('stddev_pop(distance)', 4)} AS knn_dist_std, {sr('avg(1 / (1 + distance))')} AS knn_similarity, "
    + ", ".join(f"{sr(f'{fn}({c})', d)} AS {c}_pseudo_{n}" for c in SENSORS for n, (fn, d) in NEAR_STATS.items()) + f""" FROM
 (SELECT t.id, t.is_train, {', '.join(f'p.{c}' for c in SENSORS)}, {LAY_DISTANCE} AS distance, row_number() OVER (PARTITION BY t.id ORDER BY {LAY_DISTANCE}, p.id) AS pos FROM ls t JOIN ls p ON p.layout = t.layout AND p.is_train AND p.id <> t.id) WHERE pos <= 20 GROUP BY 1""", LAY_SCALE))
def e13(spark, sf_dir):
    """Every order, either side, described by the 20 nearest training orders of its layout, itself left out: all sensors, standardised on the
    training side with its mean for unknown values."""
    op = stored(S.order_panel(spark, sf_dir).select("id", "layout", "is_train", *SENSORS))
    state = FE.fit_standard(op.where("is_train"), SENSORS)
    op = FE.fill_with(op, {c: m for c, (m, _) in state.items()})
    v = op.withColumn("v", F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in state.items()]))
    g = NB.nearest_values(v, v.where("is_train"), 20, SENSORS, ["is_train"], "euclidean", within="layout", digits=6, exclude_self=True)
    near = [F.col("n").alias("n_neighbours"), r("distance_mean", 5).alias("knn_dist_mean"), r("distance_std", 4).alias("knn_dist_std"), r("similarity").alias("knn_similarity")]
    return g.select("id", *near, *[r(f"{c}_{n}", d).alias(f"{c}_pseudo_{n}") for c in SENSORS for n, (_, d) in NEAR_STATS.items()], (F.col("is_train") == 1).alias("is_train"))


@query("j10_scenario_profile_similarity", with_sql(ORDERS_SQL, f"""SELECT sid, {sr('(a * (SELECT avg(a / n) FROM pf WHERE sid % 5 <> 0) + b * (SELECT avg(b / n) FROM pf WHERE sid % 5 <> 0) + c * (SELECT avg(c / n) FROM pf WHERE sid % 5 <> 0)) / n')} AS mean_similarity FROM pf WHERE sid % 5 = 0""",
    "pf AS (SELECT *, sqrt(a * a + b * b + c * c) + 1e-8 AS n FROM (SELECT sid, coalesce(avg(n_lines), 0) AS a, coalesce(avg(qty_avg), 0) AS b, coalesce(avg(qty_max), 0) AS c FROM op GROUP BY 1))"))
def j10(spark, sf_dir):
    """Mean cosine of a validation profile to all training profiles: one dot product with the mean training direction."""
    cols = ["n_lines", "qty_avg", "qty_max"]
    prof = S.order_panel(spark, sf_dir).groupBy("sid").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols])
    unit = prof.select("sid", FE.l2_normalise(F.array(*cols)).alias("u"))
    centre = unit.where("sid % 5 <> 0").agg(F.array(*[F.avg(F.col("u")[i]) for i in range(len(cols))]).alias("c")).scalar()
    val = unit.where("sid % 5 = 0").withColumn("c", centre)
    return val.select("sid", r(sum((F.col("u")[i] * F.col("c")[i] for i in range(len(cols))), F.lit(0.0))).alias("mean_similarity"))


WB_SQL = "wb AS (SELECT (SELECT sid FROM sc WHERE n >= 5 ORDER BY sc.mae DESC, sid LIMIT 1) AS w, (SELECT sid FROM sc WHERE n >= 5 ORDER BY sc.mae, sid LIMIT 1) AS b)"


@query("e17_cross_scenario_distance", with_sql(PRED_SQL, f"""SELECT (SELECT {sr('avg(m)', 5)} FROM (SELECT x.id, min(sqrt((x.p - z.p) ^ 2 + ((x.nt - z.nt) / 1e5) ^ 2)) AS m FROM pp x, pp z, wb WHERE x.sid = wb.w AND z.sid = wb.b GROUP BY 1)) AS mean_nearest,
 (SELECT {sr('avg(sqrt((x.p - z.p) ^ 2 + ((x.nt - z.nt) / 1e5) ^ 2))', 5)} FROM pp x, pp z, wb WHERE x.sid = wb.b AND z.sid = wb.b) AS internal_best""", SCEN_SQL, WB_SQL))
def e17(spark, sf_dir):
    rep = scenario_report(spark, sf_dir).where("n >= 5")
    worst, best = rep.orderBy(F.desc("mae"), "sid").first().sid, rep.orderBy("mae", "sid").first().sid
    v = S.pred_panel(spark, sf_dir).select("id", "sid", F.array(F.col("p"), F.col("nt") / 1e5).alias("v"))
    a, b = v.where(F.col("sid") == worst), v.where(F.col("sid") == best)
    inside = NB.mean_distance(b, b).select("mean_distance").scalar()
    return NB.nearest(a, b, 1, "euclidean").agg(r(F.avg("distance"), 5).alias("mean_nearest")).withColumn("internal_best", r(inside, 5))


# --- rows-only: iterative fits ----------------------------------------------------------------------------------


def scaled_orders(spark, sf_dir, cols=S.SENSORS):
    op = stored(S.order_panel(spark, sf_dir))  # fitting the scalers reads it several times
    train = op.where("is_train")
    winsor = FE.fit_winsor(train, cols)
    bounded = FE.apply_winsor(op, winsor)
    return FE.apply_standard(bounded, FE.fit_standard(FE.apply_winsor(train, winsor), cols))


@query("e6_multi_view_pca")
def e6(spark, sf_dir):
    rows = scaled_orders(spark, sf_dir)
    model = EM.fit_latent(rows.where("is_train"), S.SENSORS)
    return model.transform(rows.where("NOT is_train"))


@query("e7_embedding_quality")
def e7(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    q = EM.quality(v.select("id", "v"), 64)
    return v.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(q["mean_variance"]).alias("mean_variance"), F.lit(q["rms_cosine"]).alias("rms_cosine"), F.lit(EM.informative(q)).alias("informative"))


def residual_orders(spark, sf_dir):
    """Scaled orders with the residual of a simple model, the log target less the mean of its layout on the training side, in its deviations."""
    rows = scaled_orders(spark, sf_dir).withColumn("_log_y", F.log1p("y"))
    train = rows.where("is_train")
    by_layout = train.groupBy(F.col("layout").alias("_at")).agg(F.avg("_log_y").alias("_mean"))  # a layout is a nation: 25 rows and one for unknown ones
    known = rows.join(F.broadcast(by_layout), F.col("layout").eqNullSafe(F.col("_at")), "left")
    raw = F.col("_log_y") - F.coalesce(F.col("_mean"), train.agg(F.avg("_log_y")).scalar())
    return known.withColumn("residual", raw / train.agg(F.stddev_pop("_log_y")).scalar()).drop("_log_y", "_at", "_mean")


@query("e6_residual_weighted_views")
def e6_weighted(spark, sf_dir):
    """All orders in the views whose axes were fitted on training rows, badly predicted ones with more weight."""
    rows = stored(residual_orders(spark, sf_dir).select("id", "is_train", *SENSORS, "residual"))
    model = LT.fit_latents(rows.where("is_train"), SENSORS, "residual")
    return model.transform(rows, ["is_train"])


@query("e7_embedding_audit")
def e7_audit(spark, sf_dir):
    """Per view: the variance its axes explain and whether they are used; with the mode and the audit that chose it."""
    model = LT.fit_latents(stored(residual_orders(spark, sf_dir).where("is_train").select("id", *SENSORS, "residual")), SENSORS, "residual")
    found = model.audit[model.mode]
    rows = [(t, model.explained[t], not isinstance(model.used(t), int), model.mode, found["mean_variance"], found["mean_cosine"]) for t in LT.VIEWS]
    return spark.createDataFrame(rows, "view string, explained double, axes_used boolean, mode string, mean_variance double, mean_cosine double")


@query("e12_latents_by_fold")
def e12_by_fold(spark, sf_dir):
    """Latents and neighbour features of every fold's training and validation rows, each fold from its own stored pool.

    A fold's latents are fitted on its training rows, written with the pool and opened again; training rows are not their own neighbours.
    """
    rows = cut_lineage(SP.time_aware_folds(residual_orders(spark, sf_dir).where("is_train"), LATENT_FOLDS))
    ensure_checkpoint_dir(spark)
    folder, ks = f"{spark.sparkContext.getCheckpointDir()}/latents-{uuid4().hex}", (10, 20, 40)

    def fold(f):
        train = rows.where(F.col("chunk") <= f + 1)
        LT.store_fold_pool(LT.fit_latents(train, SENSORS, "residual"), train, folder, f)
        pool = LT.open_fold_pool(spark, folder, f, SENSORS)
        sides = [pool.describe(side, ks, is_train).withColumns({"fold": F.lit(f), "is_train": F.lit(is_train)}) for side, is_train in ((train, True), (rows.where(F.col("chunk") == f + 2), False))]
        return sides[0].unionByName(sides[1])

    out = None
    for part in side_by_side([partial(fold, f) for f in range(LATENT_FOLDS)]):
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)  # a fold may keep another number of dimensions
    return sync_schema(out, [c for c in out.columns if c not in ("id", "fold", "is_train")], ["id", "fold", "is_train"])


@query("e10_regime_clusters")
def e10(spark, sf_dir):
    return EM.clusters(S.vectors(spark, sf_dir), 10, name="regime_proxy").select("id", "regime_proxy")


@query("e12_latent_attach")
def e12(spark, sf_dir):
    """Neighbour features of all vectors among all others, named per k and dimension, joined back by id, checked for completeness."""
    v = S.vectors(spark, sf_dir)
    ks, dims = (10, 20, 40), 64
    g = NB.neighbourhoods(v, v, ks, exclude_self=True)
    names = [f"{p}_{k}" for k in ks for p in ("embed_mean", "embed_std", "weighted_mean", "trend_proxy")]
    wide = g.select("id", "local_density", "similarity_entropy", *[F.col(n)[d].alias(f"{n}_d{d}") for n in names for d in range(dims)])
    out = v.select("id", "label").join(wide, "id", "left")
    return sync_schema(out, [c for c in wide.columns if c != "id"], ["id", "label"])


@query("e15_tail_rate_per_cluster")
def e15(spark, sf_dir):
    rows = scaled_orders(spark, sf_dir)
    cut = fit_quantiles(rows, {"y": (F.col("y"), [0.9])})["y"][0]
    c = EM.clusters(EM.sensor_vectors(rows.withColumn("tail", F.col("y") >= cut), S.SENSORS), 100)
    return c.groupBy("cluster").agg(F.avg(F.col("tail").cast("double")).alias("tail_rate"), F.count(F.lit(1)).alias("n"))


@query("e16_low_confidence_clusters")
def e16(spark, sf_dir):
    low = tailed(spark, sf_dir).where("p <= 0.4").withColumn("v", F.array(F.col("p"), F.col("gap"), F.log1p("nt")))
    gain = F.abs(F.col("y") - F.col("nt")) - F.abs(F.col("y") - F.col("t"))
    return EM.clusters(low, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(gain).alias("avg_gain"), (1.0 - F.avg(F.col("tail").cast("double"))).alias("noise_ratio"))


@query("e18_fold_pool_guard", "WITH " + VEC_SQL + ",\n" + edge_sql("true", "a.id % 3 <> b.id % 3", 5) + f" SELECT id, nid, {sr('distance')} AS distance, CAST(pos AS INTEGER) AS pos, CAST(id % 3 AS INTEGER) AS fold FROM ed")
def e18(spark, sf_dir):
    """Neighbours of each fold's validation vectors in that fold's own pool only."""
    v = S.vectors(spark, sf_dir).withColumn("fold", (F.col("id") % 3).cast("int"))
    out = None
    for f in range(3):
        e = EM.fold_neighbours(v.where(F.col("fold") == f), v.where(F.col("fold") != f), 5).withColumn("fold", F.lit(f))
        out = e if out is None else out.unionByName(e)
    return out.select("id", "nid", r("distance").alias("distance"), "pos", "fold")


@query("e19_cluster_label_entropy")
def e19(spark, sf_dir):
    rows = scaled_orders(spark, sf_dir)
    cut = fit_quantiles(rows, {"y": (F.col("y"), [0.9])})["y"][0]
    c = EM.clusters(EM.sensor_vectors(rows.withColumn("tail", F.col("y") >= cut), S.SENSORS), 50)
    per = c.groupBy("cluster").agg(F.avg(F.col("tail").cast("double")).alias("m"))
    h = F.when((F.col("m") > 0) & (F.col("m") < 1), X.binary_entropy(F.col("m"))).otherwise(0.0)
    return per.agg(F.avg(h).alias("mean_entropy"), F.count(F.lit(1)).alias("n_clusters"))


@query("g21_pca_input_set")
def g21(spark, sf_dir):
    rows = scaled_orders(spark, sf_dir).where("is_train")
    chosen, share = EM.pca_inputs(rows, list(S.SENSORS[:4]), list(S.SENSORS[4:]))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(",".join(chosen)).alias("inputs"), F.lit(share).alias("explained"))
