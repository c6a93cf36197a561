"""Running aggregates over sorted data of any size.

``Window.orderBy`` without a partition key puts every row in one task, and with a key it puts a hot key's
rows in one task.  Here the rows are cut into ranges of the order, each range is scanned on its own, and the
running totals of earlier ranges are added afterwards.  A group may span many ranges.

An order of one number (as in value tables, where it is distinct within a group) is cut at its approximate quantiles, so
that the table is computed once, stored and shuffled once.  Any other order is range-partitioned, which also splits ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from panelforge.session import cut_lineage

_RANGE = "_range_no"


def prefix_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    before: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive ``cum_<c>`` for ``sums`` and ``runmax_<c>`` for ``maxes``; ``before_<c>`` is the largest
    ``c`` of the strictly earlier rows (of the order column itself: the previous row's value).

    ``group`` + ``order`` should identify a row, else the order among ties is arbitrary.
    """
    group, order = list(group), list(order)
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, T.NumericType):
        ranged, ranges = _cut_at_quantiles(df, order[0])
    else:
        ranged = cut_lineage(df.repartitionByRange(*group, *order).withColumn(_RANGE, F.spark_partition_id()))
        ranges = ranged.rdd.getNumPartitions()
    part = [_RANGE, *group]
    ordered = W.partitionBy(*part).orderBy(*order)
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    passed = ordered.rowsBetween(W.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        *[F.sum(c).over(running).alias(f"cum_{c}") for c in sums],
        *[F.max(c).over(running).alias(f"runmax_{c}") for c in maxes],
        *[F.max(c).over(passed).alias(f"before_{c}") for c in before],
    )
    if ranges == 1:
        return local.drop(_RANGE)

    tops = sorted({*maxes, *before})
    # One row per (range, group): at most ranges + groups rows, so this scan is small.
    totals = ranged.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        *[F.max(c).alias(f"_m_{c}") for c in tops],
    )
    earlier = (
        W.partitionBy(*(group or [F.lit(0)])).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in part],
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in sums],
        *[F.max(f"_m_{c}").over(earlier).alias(f"_m_{c}") for c in tops],
    )
    # NULL is a group like any other.
    joined = local.join(offsets, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in part], "left")
    keep = [c for c in df.columns]
    return joined.select(
        *keep,
        *[(F.coalesce(F.col(f"cum_{c}"), F.lit(0)) + F.col(f"_s_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.greatest(F.col(f"runmax_{c}"), F.col(f"_m_{c}")).alias(f"runmax_{c}") for c in maxes],
        *[F.greatest(F.col(f"before_{c}"), F.col(f"_m_{c}")).alias(f"before_{c}") for c in before],
    )


#: Rows of a range, as long as that makes no more than MOST_RANGES of them.
RANGE_ROWS, MOST_RANGES = 200_000, 2_000


def _cut_at_quantiles(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """``df``, stored, with the number of its range, and the number of ranges: each holds about as many rows of all groups together."""
    stored = cut_lineage(df)
    n = stored.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if ranges <= 1:
        return stored.withColumn(_RANGE, F.lit(0)), 1
    value = F.col(order).cast("double")
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = stored.agg(F.percentile_approx(value, shares, F.lit(10 * ranges))).first()[0]
    return range_numbers(stored, F.col(order), cuts, _RANGE), ranges


def range_numbers(df: DataFrame, value: Column, cuts: Sequence[float] | None, name: str) -> DataFrame:
    """``df`` with the number of the range of ``value`` between the cuts; NULL sorts first, NaN last."""
    edges = [-float("inf"), *(sorted({c for c in cuts or [] if abs(c) < float("inf")}) or [0.0]), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    out = cut.transform(df.withColumn("_number", value.cast("double")))
    number = F.when(F.col("_number").isNull(), -1).otherwise(F.col("_bucket").cast("int"))
    return out.withColumn(name, number).drop("_number", "_bucket")


def row_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its group, without a group-sized task."""
    one = df.withColumn("_one", F.lit(1))
    return (
        prefix_scan(one, group, order, sums=["_one"])
        .withColumn(name, (F.col("cum__one") - 1).cast("long"))
        .drop("_one", "cum__one")
    )


def melt(df: DataFrame, ids: Sequence[str], cols: dict[str, Column] | Sequence[str]) -> DataFrame:
    """Long form (ids..., feature, value), NULL values left out."""
    items = cols.items() if isinstance(cols, dict) else [(c, F.col(c)) for c in cols]
    cells = [F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in items]
    return (
        df.select(*ids, F.explode(F.array(*cells)).alias("cell"))
        .select(*ids, "cell.feature", "cell.value")
        .where(F.col("value").isNotNull())
    )


def value_counts(df: DataFrame, group: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """One row per (group, value); a value held by a third of the rows is folded map-side first."""
    measures = measures or {"n": F.count(F.lit(1))}
    return df.groupBy(*group, value).agg(*[m.alias(k) for k, m in measures.items()])
