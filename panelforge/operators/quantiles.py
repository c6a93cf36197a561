"""Exact, linearly interpolated quantiles, whole-table and per group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so it is used only behind a
row-count check.  Beyond it, a sketch brackets each quantile, rows outside the brackets are only counted,
and the few rows inside are ranked with a distributed prefix scan.  Both ways give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.operators.prefix import melt, prefix_scan, value_counts
from panelforge.session import cut_lineage

BUFFER_ROWS = 4_000_000  # values over all requests together
_SKETCH_ACCURACY = 10_000
_BRACKET = 1.0 / 2_000
#: Quantiles of a column up to which each has a condition of its own.
FEW = 4

Requests = Mapping[str, tuple[Column, Sequence[float]]]


def fit_quantiles(df: DataFrame, requests: Requests, buffer_rows: int = BUFFER_ROWS) -> dict[str, list[float]]:
    """Fitted state ``{name: [quantile, ...]}``; a handful of numbers, whatever the size of ``df``."""
    narrow = df.select(*[c.cast("double").alias(n) for n, (c, _) in requests.items()])
    counts = narrow.agg(*[F.count(n).alias(n) for n in requests]).first().asDict()
    if sum(counts.values()) <= buffer_rows:
        row = narrow.agg(
            *[F.percentile(n, F.array(*[F.lit(float(p)) for p in ps])).alias(n) for n, (_, ps) in requests.items()]
        ).first()
        return {n: [None] * len(ps) if row[n] is None else list(row[n]) for n, (_, ps) in requests.items()}
    return _by_brackets(narrow, {n: list(ps) for n, (_, ps) in requests.items()}, counts)


def _by_brackets(df: DataFrame, probs: dict[str, list[float]], counts: dict[str, int]) -> dict[str, list[float]]:
    sketch = df.agg(
        *[
            F.percentile_approx(
                n,
                F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in ps for d in (-_BRACKET, _BRACKET)]),
                F.lit(_SKETCH_ACCURACY),
            ).alias(n)
            for n, ps in probs.items()
        ]
    ).first()
    brackets: dict[str, list[tuple[float, float]]] = {}
    for n, ps in probs.items():
        if counts[n]:
            ends = [sketch[n][2 * i : 2 * i + 2] for i in range(len(ps))]
            ends = [(-math.inf if p <= _BRACKET else lo, math.inf if p >= 1 - _BRACKET or math.isnan(hi) else hi) for p, (lo, hi) in zip(ps, ends)]
            brackets[n] = _merged([x for x in ends if not math.isnan(x[0])])  # NaN comes after all numbers
    find = _few_positions if all(len(ps) <= FEW for ps in probs.values()) else _positions
    found = find(df, brackets, {n: {pos for p in probs[n] for h in [(counts[n] - 1) * p] for pos in (math.floor(h), math.ceil(h))} for n in brackets})
    out: dict[str, list[float]] = {n: [None] * len(ps) for n, ps in probs.items()}
    for n in brackets:
        missed = {}
        for i, p in enumerate(probs[n]):
            h = (counts[n] - 1) * p
            lo, hi = found.get((n, math.floor(h))), found.get((n, math.ceil(h)))
            if lo is None or hi is None:
                missed[f"p{i}"] = p
            else:
                out[n][i] = lo + (hi - lo) * (h - math.floor(h))
        if missed:  # the sketch missed: rank all values of this column instead
            row = grouped_quantiles(df, [], [n], missed).first()
            for name in missed:
                out[n][int(name[1:])] = row[name]
    return out


def _merged(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The same values as disjoint brackets in ascending order."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _positions(df: DataFrame, brackets: dict[str, list[tuple[float, float]]], wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based positions of columns, as far as they lie in the columns' brackets.

    A row gives one cell per column, however many brackets: its value inside a bracket, and only the number of its gap outside.
    """
    spark, names = df.sparkSession, list(brackets)
    if not names:
        return {}
    edges, inside = [], []
    for n in names:
        starts = [(-math.inf, False)]
        for lo, hi in brackets[n]:
            # Parts are half open: one that begins above hi leaves hi in its bracket.
            starts += [(lo, True), (math.nextafter(hi, math.inf), False)]
        starts = [x for i, x in enumerate(starts) if x[0] < math.inf and not (i + 1 < len(starts) and starts[i + 1][0] == x[0])]
        edges.append([*[e for e, _ in starts], math.inf])
        inside.append({i for i, (_, within) in enumerate(starts) if within})
    place = Bucketizer(splitsArray=edges, inputCols=names, outputCols=[f"_part_{i}" for i in range(len(names))], handleInvalid="keep")
    cells = []
    for i, n in enumerate(names):
        kept = F.col(f"_part_{i}").isin([float(x) for x in inside[i]])
        cells.append(F.struct(F.lit(i).alias("col"), F.col(f"_part_{i}").cast("int").alias("part"), F.when(kept, F.col(n)).alias("value"), F.col(n).isNotNull().alias("known")))
    long = place.transform(df.select(*names)).select(F.inline(F.array(*cells))).where("known")
    table = cut_lineage(long.groupBy("col", "part", "value").agg(F.count(F.lit(1)).alias("n")))
    gaps = {(x.col, x.part): x.n for x in table.where("value IS NULL").collect()}
    asked = []
    for i, n in enumerate(names):
        for part in inside[i]:
            before = sum(v for (c, g), v in gaps.items() if c == i and g < part)
            asked += [(i, part, before, pos) for pos in wanted[n]]
    ranked = prefix_scan(table.where("value IS NOT NULL"), ["col"], ["value"], sums=["n"])
    lookup = spark.createDataFrame(asked, "col int, part int, before long, pos long")
    end = F.col("before") + F.col("cum_n")
    # one row per wanted position and bracket
    hits = ranked.join(F.broadcast(lookup), ["col", "part"]).where((F.col("pos") < end) & (F.col("pos") >= end - F.col("n")))
    return {(names[x.col], x.pos): x.value for x in hits.select("col", "pos", "value").collect()}


def _few_positions(df: DataFrame, parts: dict[str, list[tuple[float, float]]], positions: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The same with a condition for each bracket and position, which is less work per row while they are few."""
    brackets = {f"{n}|{i}": (n, i, lo, hi) for n, own in parts.items() for i, (lo, hi) in enumerate(own)}
    if not brackets:
        return {}
    below = df.agg(*[F.count_if(F.col(n) < lo).alias(k) for k, (n, _, lo, _) in brackets.items()]).first()
    inside = {
        k: F.when((F.col(n) >= lo) & (F.col(n) <= hi), F.col(n)) for k, (n, _, lo, hi) in brackets.items()
    }
    ranked = prefix_scan(
        value_counts(melt(df, [], inside), ["feature"], "value"), ["feature"], ["value"], sums=["n"]
    )
    wanted = None
    for k, (n, i, _, _) in brackets.items():
        for pos in positions[n]:
            at = pos - below[k]
            hit = (F.col("feature") == k) & (F.col("cum_n") > at) & (F.col("cum_n") - F.col("n") <= at)
            wanted = hit if wanted is None else wanted | hit
    rows = ranked.where(wanted).select("feature", "value", "n", "cum_n").collect() if wanted is not None else []
    # Values outside their bracket never reach the rows, so a position found belongs to its column.
    return {(brackets[x.feature][0], pos): x.value for x in rows for pos in positions[brackets[x.feature][0]] if below[x.feature] + x.cum_n - x.n <= pos < below[x.feature] + x.cum_n}


def grouped_quantiles(
    df: DataFrame, group: Sequence[str], cols: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """(group..., feature, <name of prob>...): exact quantiles of any number of groups of any size."""
    group = list(group)
    key = [*group, "feature"]
    ranked = prefix_scan(value_counts(melt(df, group, list(cols)), key, "value"), key, ["value"], sums=["n"])
    sizes = ranked.groupBy(*key).agg(F.sum("n").alias("_total"))
    at = ranked.join(sizes, key)

    def value_at(pos: Column) -> Column:
        return F.max(F.when((F.col("cum_n") > pos) & (F.col("cum_n") - F.col("n") <= pos), F.col("value")))

    picks = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        picks += [
            value_at(F.floor(h)).alias(f"_lo_{name}"),
            value_at(F.ceil(h)).alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_f_{name}"),
        ]
    picked = at.groupBy(*key).agg(*picks)
    return picked.select(
        *key,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )
