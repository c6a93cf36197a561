"""The query registry and the SQL text the queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge.functions.exprs import stable_round

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build`` under ``name``; ``sql`` is its DuckDB twin."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison across engines."""
    return stable_round(F.col(c) if isinstance(c, str) else c, digits)


def sr(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``r``."""
    return f"(round(CAST({expr} AS DOUBLE) + 3.7e-{digits + 4:02d}::DOUBLE, {digits}) + 0.0)"


def hash_sql(*cols: str, seed: int = 42, digits: int = 8) -> str:
    """The SQL twin of ``splits.key_hash``."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(cols)}, '{seed}')), 1, {digits}) AS BIGINT)"


EVENTS_SQL = """
ev AS (SELECT user_id AS sid, event_id AS id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  event_type, ts < TIMESTAMP '2024-01-22' AS is_train FROM events)"""

BLOCKS_SQL = EVENTS_SQL + """,
bp AS (SELECT event_id // 25 AS sid, event_id AS id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  event_type, ts < TIMESTAMP '2024-01-22' AS is_train FROM events)"""

ORDERS_SQL = f"""
ln AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty_sum,
  {sr('avg(l_quantity)')} AS qty_avg, max(l_quantity) AS qty_max, {sr('avg(l_discount)')} AS disc_avg,
  {sr('avg(l_tax)')} AS tax_avg, {sr('sum(l_extendedprice)', 2)} AS price_sum FROM lineitem GROUP BY 1),
op AS (SELECT o_orderkey AS id, o_custkey AS sid, o_orderdate AS odate, c_nationkey AS layout, n_regionkey AS ltype,
  o_orderdate < TIMESTAMP '1999-09-01' AS is_train, o_totalprice AS y,
  n_lines, qty_sum, qty_avg, qty_max, disc_avg, tax_avg, price_sum
  FROM orders LEFT JOIN ln ON ln.id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey)"""

PRED_SQL = f"""
pr0 AS (SELECT o_orderkey AS id, o_custkey AS sid, CAST(o_orderkey % 5 AS INTEGER) AS fold, o_totalprice AS y,
  ((o_orderkey * 37) % 101) / 100.0::DOUBLE AS p,
  {sr('o_totalprice * (0.6::DOUBLE + 0.05::DOUBLE * (o_orderkey % 9))', 4)} AS nt,
  {sr('o_totalprice * (1.1::DOUBLE + 0.4::DOUBLE * ((o_orderkey * 7) % 11))', 4)} AS t FROM orders),
pr1 AS (SELECT *, abs(t - nt) / (nt + 1e-6) AS g0,
  CASE WHEN p > 0.65 OR (t > nt * 2.0 AND p > 0.4) THEN 1.0 / (1.0 + exp(-8.0 * (p - 0.55))) ELSE pow(p, 1.5) END AS w0 FROM pr0),
pr2 AS (SELECT *, {sr('g0', 9)} AS gap,
  {sr('w0 * least(greatest(1.0 - least(greatest((g0 - 3.0) / 3.0, 0.0), 2.0) * least(greatest((0.7 - p) / 0.7, 0.0), 1.0) * 0.5, 0.5), 1.0)', 9)} AS w
  FROM pr1),
pp AS (SELECT id, sid, fold, y, p, nt, t, gap, w,
  CASE WHEN id % 7 <> 0 THEN {sr('w * t + (1.0 - w) * nt', 4)} END AS oof FROM pr2)"""


def with_sql(base: str, body: str, *more: str) -> str:
    return "WITH " + ",\n".join([base.strip(), *[m.strip() for m in more]]) + "\n" + body
