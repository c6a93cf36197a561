"""Exact running median of a sequence too long for one task.

The sequence is cut into segments of ``rows`` positions.  While a segment is walked, the median can move by at
most ``rows`` ranks, so the walk needs only the earlier values whose rank is that close to the median at the
segment's start, plus how many earlier values lie below and above them.  Which value buckets hold those ranks is
read off a (segment, bucket) count table; every task then sees a few ``rows`` worth of values.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.operators.prefix import row_positions
from panelforge.session import cut_lineage


class MedianWalk:
    """Median of a growing multiset: the lower half in one heap, the upper half in another.

    ``below`` values are known to lie under all of ``near`` and to stay under the median for the whole walk.
    """

    def __init__(self, near: list[float] | None = None, below: int = 0, total: int = 0):
        near = sorted(near or [])
        self.total, self.below = total, below
        self.floor = near[0] if near and below else None
        keep = max(0, (total + 1) // 2 - below)
        self.low = [-v for v in reversed(near[:keep])]  # largest of the lower half first
        self.high = near[keep:]
        heapq.heapify(self.low)

    def add(self, v: float) -> None:
        self.total += 1
        if self.floor is not None and v < self.floor:
            self.below += 1
        elif self.low and v <= -self.low[0]:
            heapq.heappush(self.low, -v)
        else:
            heapq.heappush(self.high, v)
        want = (self.total + 1) // 2 - self.below
        while len(self.low) > want and self.low:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        while len(self.low) < want and self.high:
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def median(self) -> float | None:
        if not self.total:
            return None
        return -self.low[0] if self.total % 2 else (-self.low[0] + self.high[0]) / 2.0

    def run(self, values, past: bool) -> list[float | None]:
        out = []
        for v in values:
            if past:
                out.append(self.median())
            if pd.notna(v):
                self.add(v)
            if not past:
                out.append(self.median())
        return out


def sequence_key(sid: str) -> Column:
    """The sequence as a string that is never NULL, so that rows without an id are a sequence like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(sid).cast("string")), F.lit(""))


def walk_medians(df: DataFrame, sid: str, order: Sequence[str], medians: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Add the expanding medians ``{name: (column, past)}``, one walk for each sequence; sequences must fit a task."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    cols = sorted({c for c, _ in medians.values()})
    feed = cut_lineage(keyed)
    names = ", ".join(f"`{n}` double" for n in medians)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([f"_k{i}" for i in range(len(order))], kind="stable")
        out = {"_row": pdf["_row"].to_numpy()}
        for n, (c, past) in medians.items():
            out[n] = pd.Series(MedianWalk().run(pdf[f"_c_{c}"].tolist(), past), dtype="float64").to_numpy()
        return pd.DataFrame(out)

    narrow = feed.select("_row", sequence_key(sid).alias("_sid"), *[F.col(o).alias(f"_k{i}") for i, o in enumerate(order)], *[F.col(c).cast("double").alias(f"_c_{c}") for c in cols])
    got = narrow.groupBy("_sid").applyInPandas(walk, f"_row long, {names}")
    got = got.select("_row", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in medians])
    return feed.join(got, "_row").drop("_row")


#: A bucket of values is dealt over so many keys, as the buckets around the median are wanted by every segment.
SALTS = 16


def running_median(df: DataFrame, sid: str, pos: str, col: str, name: str, past: bool, rows: int) -> DataFrame:
    """Add ``name``: the median of the non-NULL ``col`` at positions up to this one (``past``: before it)."""
    df = df.withColumn("_sid", sequence_key(sid))
    base = df.select(
        "_sid", F.col(pos).alias("_p"), F.col(col).cast("double").alias("_v"), F.floor(F.col(pos) / rows).alias("_seg")
    )
    known = row_positions(base.where(F.col("_v").isNotNull()), ["_sid"], ["_v", "_p"], "_rank")
    known = cut_lineage(known.withColumn("_bucket", F.floor(F.col("_rank") / rows)))

    # Sparse (segment, bucket) counts and their totals over earlier segments: (n / rows)^2 cells per sequence.
    cells = known.groupBy("_sid", "_seg", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    segs, buckets = base.select("_sid", "_seg").distinct(), cells.select("_sid", "_bucket").distinct()
    grid = segs.join(buckets, "_sid").join(cells, ["_sid", "_seg", "_bucket"], "left").fillna(0, ["n"])
    earlier = W.partitionBy("_sid", "_bucket").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    by_bucket = W.partitionBy("_sid", "_seg").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("_sid", "_seg")
    table = (
        grid.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("cum", F.sum("before").over(by_bucket))
        .withColumn("total", F.sum("before").over(whole))
        .withColumn("near", (F.col("cum") >= F.col("total") / 2 - rows) & (F.col("cum") - F.col("before") <= F.col("total") / 2 + rows))
    )
    below = table.groupBy("_sid", "_seg").agg(
        F.coalesce(F.sum(F.when(~F.col("near") & (F.col("cum") < F.col("total") / 2), F.col("before"))), F.lit(0)).alias("_below"),
        F.max("total").alias("_total"),
    )
    wanted = table.where("near and before > 0").select("_sid", F.col("_seg").alias("_for"), "_bucket")
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int"))
    halo = (
        salted.join(wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_sid", "_bucket", "_salt"])
        .where(F.col("_seg") < F.col("_for"))
        .select("_sid", F.col("_for").alias("_seg"), F.lit(-1).cast("long").alias("_p"), "_v")
    )
    own = base.select("_sid", "_seg", "_p", "_v")
    feed = own.unionByName(halo).join(below, ["_sid", "_seg"], "left")
    schema = f"_sid string, _p bigint, {name} double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["_p"] >= 0].sort_values("_p")
        start = MedianWalk(pdf.loc[pdf["_p"] < 0, "_v"].tolist(), int(pdf["_below"].iloc[0]), int(pdf["_total"].iloc[0]))
        found = pd.Series(start.run(mine["_v"].tolist(), past), dtype="float64").to_numpy()
        return pd.DataFrame({"_sid": mine["_sid"].to_numpy(), "_p": mine["_p"].to_numpy(), name: found})

    medians = feed.groupBy("_sid", "_seg").applyInPandas(walk, schema)
    medians = medians.withColumn(name, F.when(F.isnan(name), None).otherwise(F.col(name))).withColumnRenamed("_p", pos)
    return df.join(medians, ["_sid", pos], "left").drop("_sid")
