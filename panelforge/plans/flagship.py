"""The first end-to-end query: sequence features, train/test split, drift of each feature, top 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.operators import drift, panel as P
from panelforge.plans.registry import EVENTS_SQL, query, r, sr, with_sql
from panelforge.sources import panels as S

FEATURES = [
    c + s for c in ("value", "k") for s in ("", "_rolling_mean_3", "_rolling_std_3", "_rolling_mean_5", "_rolling_std_5", "_diff_1", "_slope_5", "_rate_1", "_rel_to_mean_5")
]


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.events_panel(spark, sf_dir)
    feats = P.time_series_features(ev, S.EVENTS, {"value": "sensor", "k": "count"}, {"value": 0.0})
    return feats.select("id", "is_train", *[r(c, 9).alias(c) for c in FEATURES])


def _window_sql(c: str, fill: str) -> str:
    return f"""
coalesce(avg({c}) OVER r3, 0.0) AS {c}_rolling_mean_3, coalesce(stddev_samp({c}) OVER r3, 0.0) AS {c}_rolling_std_3,
coalesce(avg({c}) OVER r5, 0.0) AS {c}_rolling_mean_5, coalesce(stddev_samp({c}) OVER r5, 0.0) AS {c}_rolling_std_5,
{c} - coalesce(lag({c}) OVER w, {fill}) AS {c}_diff_1"""


EVENT_FEATURES_SQL = f"""
f1 AS (SELECT *, {_window_sql('value', 'coalesce(avg(value) OVER past, 0.0)')}, {_window_sql('k', '0.0')}
  FROM ev WINDOW w AS (PARTITION BY sid ORDER BY ts, id),
  r3 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  r5 AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  past AS (PARTITION BY sid ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT *, {', '.join(f'''coalesce(({c}_rolling_mean_5 - lag({c}_rolling_mean_5, 4) OVER w) / 5.0, 0.0) AS {c}_slope_5,
  {c}_diff_1 / (abs({c}) + 1.0) AS {c}_rate_1,
  CASE WHEN abs({c}_rolling_mean_5) > 1.1920928955078125e-07 THEN ({c} - {c}_rolling_mean_5) / ({c}_rolling_mean_5 + 1.1920928955078125e-07) ELSE 0.0 END AS {c}_rel_to_mean_5'''
  for c in ('value', 'k'))}
  FROM f1 WINDOW w AS (PARTITION BY sid ORDER BY ts, id)),
f3 AS (SELECT id, is_train, {', '.join(f'{sr(c, 9)} AS {c}' for c in FEATURES)} FROM f2),
long AS (UNPIVOT f3 ON {', '.join(FEATURES)} INTO NAME feature VALUE v)"""

KS_SQL = """
sides AS (SELECT feature, v, sum(CASE WHEN is_train THEN 1 ELSE 0 END) AS a, sum(CASE WHEN is_train THEN 0 ELSE 1 END) AS b
  FROM long GROUP BY 1, 2),
cdf AS (SELECT feature, v, sum(a) OVER o * 1.0 / sum(a) OVER (PARTITION BY feature) AS fa,
  sum(b) OVER o * 1.0 / sum(b) OVER (PARTITION BY feature) AS fb FROM sides
  WINDOW o AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT feature, max(abs(CAST(fa AS DOUBLE) - CAST(fb AS DOUBLE))) AS ks_stat FROM cdf GROUP BY 1)"""


@query(
    "drift_top_features",
    with_sql(
        EVENTS_SQL,
        f"SELECT feature, {sr('ks_stat')} AS ks_stat FROM ks ORDER BY ks.ks_stat DESC, feature LIMIT 10",
        EVENT_FEATURES_SQL,
        KS_SQL,
    ),
)
def drift_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = event_features(spark, sf_dir)
    ks = drift.ks_table(feats, FEATURES, F.col("is_train"))
    return ks.orderBy(F.desc("ks_stat"), "feature").limit(10).select("feature", r("ks_stat").alias("ks_stat"))
