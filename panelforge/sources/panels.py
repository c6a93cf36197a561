"""Panels over the driver tables, and typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions import exprs as X
from panelforge.operators.panel import Panel

EVENT_SPLIT = "2024-01-22"
ORDER_SPLIT = "1999-09-01"

EVENTS = Panel("sid", ("ts", "id"))
BLOCKS = Panel("sid", ("id",))
ORDERS = Panel("sid", ("odate", "id"))

SENSORS = ("n_lines", "qty_sum", "qty_avg", "qty_max", "disc_avg", "tax_avg", "price_sum")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence per user; sensors ``value`` and ``k``; train before EVENT_SPLIT."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"),
        F.col("event_id").alias("id"),
        "ts",
        X.clean(F.col("value")).alias("value"),
        X.clean(F.get_json_object("props", "$.k")).alias("k"),
        "event_type",
        (F.col("ts") < F.lit(EVENT_SPLIT).cast("timestamp_ntz")).alias("is_train"),
    )


def block_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous, non-overlapping sequences of 25 events, as time-aware folds expect."""
    return events_panel(spark, sf_dir).withColumn("sid", F.floor(F.col("id") / 25))


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with per-order line aggregates as sensors (NULL for orders without lines)."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumns({c: X.clean(F.col(c)) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")})
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_lines"),
            F.sum("l_quantity").alias("qty_sum"),
            X.stable_round(F.avg("l_quantity"), 6).alias("qty_avg"),
            F.max("l_quantity").alias("qty_max"),
            X.stable_round(F.avg("l_discount"), 6).alias("disc_avg"),
            X.stable_round(F.avg("l_tax"), 6).alias("tax_avg"),
            X.stable_round(F.sum("l_extendedprice"), 2).alias("price_sum"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("sid"),
        F.col("o_orderdate").alias("odate"),
        X.clean(F.col("o_totalprice")).alias("y"),
        (F.col("o_orderdate") < F.lit(ORDER_SPLIT).cast("timestamp_ntz")).alias("is_train"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sid"), F.col("c_nationkey").alias("layout")
    )
    layouts = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("layout"), F.col("n_regionkey").alias("ltype")
    )
    return (
        orders.join(lines, "id", "left")
        .join(customers, "sid", "left")
        # nation has 25 rows at every scale factor
        .join(F.broadcast(layouts), "layout", "left")
        .select("id", "sid", "odate", "layout", "ltype", "is_train", "y", *SENSORS)
    )


def pred_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-predictions with a formula, so that blends and metrics have an exact answer."""
    i, y = F.col("id"), F.col("y")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sid"), X.clean(F.col("o_totalprice")).alias("y")
    )
    base = orders.select(
        "id",
        "sid",
        (i % 5).cast("int").alias("fold"),
        "y",
        ((i * 37) % 101 / 100.0).alias("p"),
        X.stable_round(y * (0.6 + 0.05 * (i % 9)), 4).alias("nt"),
        X.stable_round(y * (1.1 + 0.4 * ((i * 7) % 11)), 4).alias("t"),
    )
    p, t, nt = F.col("p"), F.col("t"), F.col("nt")
    weighted = base.select(
        "*",
        X.stable_round(X.prediction_gap(t, nt), 9).alias("gap"),
        X.stable_round(X.blend_weight(p, t, nt) * X.damping(p, X.prediction_gap(t, nt)), 9).alias("w"),
    )
    # One row in seven has no out-of-fold prediction.  Filters use the flag: a filter on ``oof IS NOT NULL`` would
    # be pushed below the projections and evaluate the whole blend a second time.
    has = i % 7 != 0
    return weighted.select("*", has.alias("has_oof"), F.when(has, X.stable_round(X.blend(F.col("w"), t, nt), 4)).alias("oof"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label"
    )


MODEL_FEATURES = ("n_lines", "qty_sum", "qty_avg", "qty_max", "disc_avg", "tax_avg")


def model_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines, target = their summed price; sequences are calendar months, ordered by ``day``."""
    return (
        order_panel(spark, sf_dir)
        .where("price_sum IS NOT NULL")
        .select(
            "id",
            (F.year("odate") * 12 + F.month("odate")).alias("sid"),
            F.datediff("odate", F.lit("1995-01-01")).cast("long").alias("day"),
            "layout",
            "ltype",
            "is_train",
            F.col("price_sum").alias("y"),
            *MODEL_FEATURES,
        )
    )
