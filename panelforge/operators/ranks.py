"""Ranks with averaged ties, ranking metrics and empirical distribution functions.

All of them work on value tables (one row per distinct value), so ties cost nothing and a hot value
never reaches one task as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators.prefix import MOST_RANGES, melt, prefix_scan, range_numbers, value_counts
from panelforge.session import cut_lineage, stored


def tie_ranks(df: DataFrame, group: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Add the 1-based average rank (ascending) of ``value`` inside ``group`` and the group size ``<name>_n``."""
    group = list(group)
    counts = value_counts(df.where(F.col(value).isNotNull()), group, value)
    ranked = prefix_scan(counts, group, [value], sums=["n"])
    table = ranked.select(*group, value, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(name))
    if group:
        sizes = counts.groupBy(*group).agg(F.sum("n").alias(f"{name}_n"))
        return df.join(table, [*group, value], "left").join(sizes, group, "left")
    size = counts.agg(F.sum("n").alias("n")).scalar()
    return df.join(table, [value], "left").withColumn(f"{name}_n", size)


def percent_rank_ties(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank divided by the group size, in (0, 1]."""
    return tie_ranks(df, group, value, "_r").withColumn(name, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def scored_counts(df: DataFrame, group: Sequence[str], score: str, label: Column) -> DataFrame:
    """(group..., score, pos, neg): how many positives and negatives share each score."""
    return value_counts(
        df.where(F.col(score).isNotNull()), list(group), score, pos=F.count_if(label), neg=F.count_if(~label)
    )


def roc_auc(df: DataFrame, group: Sequence[str], score: str, label: Column) -> DataFrame:
    """Exact area under the ROC curve per group, half a point per tie; NULL where one class is absent."""
    group = list(group)
    ranked = prefix_scan(scored_counts(df, group, score, label), group, [score], sums=["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    both = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*group).agg(
        F.try_divide(wins, both.cast("double")).alias("auc"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )


def pr_points(df: DataFrame, group: Sequence[str], score: str, label: Column) -> DataFrame:
    """Precision/recall at every distinct score, from the highest down (prev_* = the point before)."""
    group = list(group)
    counts = scored_counts(df, group, score, label).withColumn("_down", -F.col(score))
    run = prefix_scan(counts, group, ["_down"], sums=["pos", "neg"])
    total = counts.groupBy(*group).agg(F.sum("pos").alias("_p")) if group else None
    pts = run.join(total, group) if group else run.withColumn("_p", counts.agg(F.sum("pos").alias("p")).scalar())
    tp, fp, p = F.col("cum_pos"), F.col("cum_neg"), F.col("_p")
    return pts.select(
        *group,
        score,
        (tp / (tp + fp)).alias("precision"),
        F.try_divide(tp.cast("double"), p.cast("double")).alias("recall"),
        F.try_divide((tp - F.col("pos")).cast("double"), p.cast("double")).alias("prev_recall"),
        F.coalesce(
            F.try_divide((tp - F.col("pos")).cast("double"), (tp - F.col("pos") + fp - F.col("neg")).cast("double")),
            F.lit(1.0),
        ).alias("prev_precision"),
    )


def rank_against_reference(df: DataFrame, reference: DataFrame, value: str, name: str) -> DataFrame:
    """Share of ``reference`` values strictly below ``value``: count / (size + 1), the reference frozen at fit time."""
    ref = reference.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("r"))
    seen = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.lit(0).cast("long").alias("r"))
    both = ref.unionByName(seen).groupBy(value).agg(F.sum("r").alias("r"))
    below = prefix_scan(both, [], [value], sums=["r"]).select(value, (F.col("cum_r") - F.col("r")).alias("_below"))
    size = reference.agg(F.count(value).alias("n")).scalar()
    return (
        df.join(below, [value], "left")
        .withColumn(name, F.col("_below") / (size + F.lit(1.0)))
        .drop("_below")
    )


#: Distinct values of a column up to which their ranks are sent to all tasks.
SENT_VALUES = 100_000
#: Rows that are ranked by one scan where a column has more values than that.
SCAN_ROWS = 50_000


@dataclass
class Reference:
    """Values of frozen rows, counted once, that any other rows are ranked against.

    The values of a column with few are sorted arrays that travel to the tasks, whatever the rows to rank; the others stay a table.
    """

    sizes: dict[str, int]
    few: dict[str, tuple[np.ndarray, np.ndarray]]
    many: dict[str, tuple[DataFrame, int]]

    @staticmethod
    def of(rows: DataFrame, cols: Sequence[str]) -> Reference:
        table = stored(value_counts(melt(rows, [], list(cols)), ["feature"], "value", r=F.count(F.lit(1))))
        # one row per column of the schema
        known = {x.feature: x for x in table.groupBy("feature").agg(F.sum("r").alias("size"), F.count(F.lit(1)).alias("distinct")).collect()}
        few, many = {}, {}
        for c in cols:
            own = table.where(F.col("feature") == c).select("value", "r")
            if c in known and known[c].distinct > SENT_VALUES:
                many[c] = (own, known[c].distinct)
                continue
            found = own.orderBy("value").toPandas()  # at most SENT_VALUES rows
            below = np.r_[0, np.cumsum(found["r"].to_numpy(dtype=np.int64))]
            few[c] = (found["value"].to_numpy(dtype=float), below / (below[-1] + 1.0))
        return Reference({c: known[c].size if c in known else 0 for c in cols}, few, many)

    def ranked(self, df: DataFrame, key: str, name: str = "{}") -> DataFrame:
        """``df`` with the share of reference values strictly below each column's value, NULL for NULL, as ``name`` of the column.

        Rows stay where they lie, except for columns of many values: each takes one shuffle of the rows.
        """
        for c, (table, distinct) in self.many.items():
            df = _ranked_in_ranges(df, table, distinct, self.sizes[c], key, c, f"_rank_{c}")
        shares = {c: F.col(f"_rank_{c}") for c in self.many} | {c: F.when(F.col(c).isNotNull(), _looked_up(*t)(F.col(c).cast("double"))) for c, t in self.few.items()}
        return df.withColumns({name.format(c): shares[c] for c in self.sizes}).drop(*[f"_rank_{c}" for c in self.many])


def _looked_up(values: np.ndarray, shares: np.ndarray):
    @F.pandas_udf("double")
    def rank(x: pd.Series) -> pd.Series:
        return pd.Series(shares[np.searchsorted(values, x.to_numpy(dtype=float))])

    return rank


def _ranked_in_ranges(df: DataFrame, table: DataFrame, distinct: int, size: int, key: str, value: str, name: str) -> DataFrame:
    """Rows and reference values (value, r) meet in ranges of the value. A range of many rows, as a hot value is, is several scans, each
    with the range's reference values."""
    ranges = min(MOST_RANGES, -(-max(distinct, df.count()) // SCAN_ROWS))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = table.agg(F.percentile_approx("value", shares, F.lit(10 * ranges))).first()[0] if ranges > 1 else []
    rows, values = range_numbers(df, F.col(value), cuts, "_range"), range_numbers(table, F.col("value"), cuts, "_range")
    held = {x["_range"]: x.r for x in values.groupBy("_range").agg(F.sum("r").alias("r")).collect()}
    met = {x["_range"]: x["count"] for x in rows.groupBy("_range").count().collect()}
    at = sorted(held.keys() | met.keys())
    before = np.r_[0, np.cumsum([held.get(i, 0) for i in at])].tolist()
    scans = [-(-met.get(i, 0) // SCAN_ROWS) for i in at]
    plan = df.sparkSession.createDataFrame(list(zip(at, before, scans)), "_range int, _before long, _scans int")  # at most MOST_RANGES rows and one for unknown values
    rows = rows.join(F.broadcast(plan), "_range").withColumns({"_scan": F.pmod(F.xxhash64(key), F.col("_scans")).cast("int"), "_at": F.col(value).cast("double"), "_kind": F.lit(0), "_r": F.lit(0).cast("long")})
    values = values.join(F.broadcast(plan.where("_scans > 0")), "_range").select("_range", F.explode(F.sequence(F.lit(0), F.col("_scans") - 1)).alias("_scan"), F.col("value").alias("_at"), F.lit(1).alias("_kind"), F.col("r").alias("_r"))
    both = rows.unionByName(values, allowMissingColumns=True).repartition(max(sum(scans), 1), "_range", "_scan")
    # Rows come before the equal reference value.
    run = F.sum("_r").over(W.partitionBy("_range", "_scan").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    out = both.withColumn("_below", run).where("_kind = 0")
    return out.withColumn(name, F.when(F.col("_at").isNotNull(), (F.col("_below") + F.col("_before")) / F.lit(size + 1.0))).select(*df.columns, name)


def ranks_against_reference(df: DataFrame, reference: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """(key, col...): the same for many columns at once."""
    return Reference.of(reference, cols).ranked(df.select(key, *cols), key)


#: Rows of a group up to which a plain window ranks it.
GROUP_ROWS = 100_000


def tie_ranks_of_columns(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """``df`` with the average rank of every column inside its group as ``_rank_<c>``; NULL is a group, unknown values have no rank.

    All columns share one shuffle by group. Groups of more than ``GROUP_ROWS`` rows are ranked by value tables instead.
    """
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS)
    large = cut_lineage(sizes.select("_g"))
    same = df[group].eqNullSafe(large["_g"])
    rows = df if large.isEmpty() else df.join(F.broadcast(large), same, "left_anti")  # at most a row per GROUP_ROWS rows
    placed = {}
    for c in cols:
        order = W.partitionBy(group).orderBy(F.col(c).asc_nulls_last())
        ties = F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow))
        placed[f"_rank_{c}"] = F.when(F.col(c).isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)
    out = rows.select("*", *[v.alias(k) for k, v in placed.items()])
    if large.isEmpty():
        return out
    hot = df.join(F.broadcast(large), same, "left_semi")
    for c in cols:
        counts = value_counts(hot.where(F.col(c).isNotNull()), [group], c)
        table = prefix_scan(counts, [group], [c], sums=["n"])
        table = table.select(F.col(group).alias("_g"), F.col(c).alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(f"_rank_{c}"))
        hot = hot.join(table, F.col(group).eqNullSafe(F.col("_g")) & (F.col(c) == F.col("_v")), "left").drop("_g", "_v")
    return out.unionByName(hot)


def rank_correlations(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(feature, pearson, spearman) of every column with ``y``, over the rows where both are known.

    Columns that are known in the same rows share the ranks of ``y``: they are ranked side by side, not row by row for each column.
    """
    rows = stored(df.where(F.col(y).isNotNull()).select(F.col(y).cast("double"), *[F.col(c).cast("double") for c in cols]))
    known = lambda *cs: F.count_if(reduce(and_, [F.col(c).isNotNull() for c in cs]))
    n = rows.agg(*[known(c, d).alias(f"{c}|{d}") for c, d in combinations_with_replacement(cols, 2)]).first()
    parts: list[list[str]] = []
    for c in cols:
        part = next((p for p in parts if n[f"{p[0]}|{p[0]}"] == n[f"{p[0]}|{c}"] == n[f"{c}|{c}"]), None)
        parts.append([c]) if part is None else part.append(c)
    found = [_rank_correlations(rows.where(F.col(p[0]).isNotNull()).select(y, *p), p, y) for p in parts]
    return reduce(DataFrame.unionByName, found)


def _rank_correlations(rows: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """The same for rows that know ``y`` and all columns."""
    every = [*cols, y]
    ranked = prefix_scan(value_counts(melt(rows, [], every), ["feature"], "value"), ["feature"], ["value"], sums=["n"])
    table = cut_lineage(ranked.select("feature", "value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank")))
    distinct = {x.feature: x["count"] for x in table.groupBy("feature").count().collect()}
    out = rows
    for c in sorted(every, key=lambda c: distinct.get(c, 0)):
        own = table.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"))
        out = out.join(F.broadcast(own) if distinct.get(c, 0) <= SENT_VALUES else own, c)
    row = out.agg(*[x for c in cols for x in (X.corr(c, y).alias(f"p_{c}"), X.corr(f"_rank_{c}", f"_rank_{y}").alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("pearson"), F.col(f"s_{c}").alias("spearman"), F.col(f"n_{c}").alias("n")) for c in cols]
    return row.select(F.inline(F.array(*cells))).where("n > 0").drop("n")
