"""Ordered-panel features: what a row can know from the rows before it in its own sequence.

Short sequences use plain window functions over (sequence, order).  A sequence longer than ``HOT_ROWS`` is cut
into fixed segments that each carry a copy of the ``lookback`` rows before them, and its expanding values come
from a prefix scan, so no task ever holds a whole hot sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F
from pyspark.sql import Window as W

from panelforge.functions import exprs as X
from panelforge.operators.prefix import prefix_scan, row_positions
from panelforge.operators.running_median import running_median, walk_medians

HOT_ROWS = 1_000_000
#: From sequences of this length on, expanding medians come from a walk with two heaps: a median over a growing
#: window frame sorts the frame again for each row.
MEDIAN_ROWS = 1_000
SEGMENT_ROWS = 200_000
MAX_HOT_IDS = 1_000


@dataclass(frozen=True)
class Panel:
    """Which column names the sequence and which ones order it (a total order inside the sequence)."""

    sid: str
    order: tuple[str, ...]

    def window(self) -> WindowSpec:
        return W.partitionBy(self.sid).orderBy(*self.order)


@dataclass(frozen=True)
class Expanding:
    """Expanding aggregate of ``col``: kind is mean, std, max, sum or median; ``past`` leaves the row itself out."""

    kind: str
    col: str
    past: bool = False


Local = Callable[[DataFrame, WindowSpec], DataFrame]


def longest_sequence(df: DataFrame, sid: str) -> int:
    sizes = df.groupBy(sid).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def hot_sequences(df: DataFrame, sid: str, hot_rows: int) -> list | None:
    """Ids (NULL is one) of over-long sequences, at most MAX_HOT_IDS of them; None when there are more than that."""
    sizes = df.groupBy(sid).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    ids = [r[0] for r in sizes.select(sid).take(MAX_HOT_IDS + 1)]
    return None if len(ids) > MAX_HOT_IDS else ids


def sequence_features(
    df: DataFrame,
    panel: Panel,
    local: Local | None = None,
    lookback: int = 8,
    expanding: Mapping[str, Expanding] | None = None,
    hot_rows: int | None = None,
    segment_rows: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Add ``timestep_index``, the expanding columns, and whatever ``local`` derives from ``lookback`` past rows.

    Rows with a NULL id are one sequence. The way chosen (windows, walks, segments) depends on the longest sequence and gives the
    same values; a caller that knows a bound for it passes ``longest`` and saves the count.
    """
    expanding = dict(expanding or {})
    local = local or (lambda d, w: d)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    segment_rows = max(lookback, SEGMENT_ROWS if segment_rows is None else segment_rows)
    longest = longest_sequence(df, panel.sid) if longest is None else longest
    walk = longest > MEDIAN_ROWS
    if longest <= hot_rows:
        return _by_window(df, panel, local, expanding, walk)
    hot = hot_sequences(df, panel.sid, hot_rows)
    if hot is None:
        return _by_segments(df, panel, local, lookback, expanding, segment_rows)
    is_hot = F.coalesce(F.col(panel.sid).isin([h for h in hot if h is not None]), F.lit(None in hot))
    return _by_window(df.where(~is_hot), panel, local, expanding, walk).unionByName(
        _by_segments(df.where(is_hot), panel, local, lookback, expanding, segment_rows)
    )


def _by_window(df: DataFrame, panel: Panel, local: Local, expanding: Mapping[str, Expanding], walk: bool) -> DataFrame:
    w = panel.window()
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    aggregate = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "max": F.max,
        "sum": F.sum,
        "median": lambda c: F.percentile(c, F.lit(0.5)),
    }
    walked = {n: e for n, e in expanding.items() if walk and e.kind == "median"}
    base = walk_medians(df, panel.sid, panel.order, {n: (e.col, e.past) for n, e in walked.items()}) if walked else df
    added = [
        aggregate[e.kind](F.col(e.col)).over(before if e.past else upto).alias(name) for name, e in expanding.items() if name not in walked
    ]
    return local(base.select("*", (F.row_number().over(w) - 1).alias("timestep_index"), *added), w)


def _by_segments(
    df: DataFrame, panel: Panel, local: Local, lookback: int, expanding: Mapping[str, Expanding], rows: int
) -> DataFrame:
    placed = row_positions(df, [panel.sid], list(panel.order), "_pos")
    out = _expanding_by_scan(placed, panel, expanding, rows) if expanding else placed
    seg = F.floor(F.col("_pos") / rows)
    near_end = (F.col("_pos") % rows) >= rows - lookback
    copies = out.select(
        "*",
        F.col("_pos").cast("int").alias("timestep_index"),
        F.explode(F.when(near_end, F.array(seg, seg + 1)).otherwise(F.array(seg))).alias("_seg"),
    )
    w = W.partitionBy(panel.sid, "_seg").orderBy(*panel.order)
    own = F.col("_seg") == F.floor(F.col("_pos") / rows)
    return local(copies, w).where(own).drop("_pos", "_seg")


def _expanding_by_scan(df: DataFrame, panel: Panel, expanding: Mapping[str, Expanding], rows: int) -> DataFrame:
    cols = sorted({e.col for e in expanding.values() if e.kind != "median"})
    # Centre first: sums of squares of large values would lose the digits the variance lives in.
    centre = df.groupBy(F.col(panel.sid).alias("_csid")).agg(*[F.avg(c).alias(f"_c_{c}") for c in cols], F.lit(0).alias("_c"))
    work = df.join(centre, F.col(panel.sid).eqNullSafe(F.col("_csid"))).drop("_csid")
    for c in cols:
        work = work.withColumns(
            {
                f"_x_{c}": F.coalesce(F.col(c) - F.col(f"_c_{c}"), F.lit(0.0)),
                f"_n_{c}": F.col(c).isNotNull().cast("long"),
                f"_v_{c}": F.col(c).cast("double"),
            }
        ).withColumn(f"_q_{c}", F.col(f"_x_{c}") * F.col(f"_x_{c}"))
    sums = [f"_{k}_{c}" for c in cols for k in "xnq"]
    work = prefix_scan(work, [panel.sid], ["_pos"], sums=sums, maxes=[f"_v_{c}" for c in cols])
    for name, e in expanding.items():
        if e.kind == "median":
            work = running_median(work, panel.sid, "_pos", e.col, name, e.past, rows)
            continue
        own = F.lit(1 if e.past else 0)
        x = F.col(f"cum__x_{e.col}") - own * F.col(f"_x_{e.col}")
        n = F.col(f"cum__n_{e.col}") - own * F.col(f"_n_{e.col}")
        q = F.col(f"cum__q_{e.col}") - own * F.col(f"_q_{e.col}")
        centred = F.try_divide(x, n.cast("double"))
        if e.kind == "mean":
            value = centred + F.col(f"_c_{e.col}")
        elif e.kind == "sum":
            value = F.when(n > 0, x + n * F.col(f"_c_{e.col}"))
        elif e.kind == "std":
            value = F.when(n > 1, F.sqrt(F.greatest(q - x * centred, F.lit(0.0)) / (n - 1)))
        elif e.kind == "max" and not e.past:
            value = F.col(f"runmax__v_{e.col}")
        else:
            raise ValueError(f"no scan for {e}")
        work = work.withColumn(name, value)
    return work.select(*df.columns, *expanding)


# --- the named feature families ---------------------------------------------------------------------------


def clock_columns() -> dict[str, Column]:
    """Step clock: position / 24, the first five steps, the very first step."""
    t = F.col("timestep_index")
    return {
        "normalized_time": t / F.lit(24.0),
        "cold_start_flag": (t < 5).cast("int"),
        "is_scenario_boundary": (t == 0).cast("int"),
    }


def back(w: WindowSpec, n: int) -> WindowSpec:
    """Frame of the last ``n`` rows, the current one included."""
    return w.rowsBetween(-(n - 1), 0)


def rolling_columns(c: str, w: WindowSpec, sizes: Sequence[int] = (3, 5)) -> dict[str, Column]:
    out = {}
    for n in sizes:
        out[f"{c}_rolling_mean_{n}"] = F.coalesce(F.avg(c).over(back(w, n)), F.lit(0.0))
        out[f"{c}_rolling_std_{n}"] = F.coalesce(F.stddev_samp(c).over(back(w, n)), F.lit(0.0))
    return out


def past_fill(c: str, kind: str, train_mean: float | None) -> tuple[Column, Expanding | None]:
    """What stands in for a missing value of ``c``, by its kind, and the expanding column that needs."""
    if kind == "count":
        return F.lit(0.0), None
    if kind == "ratio":
        return F.coalesce(F.col(f"_past_{c}"), F.lit(0.0)), Expanding("median", c, past=True)
    return F.coalesce(F.col(f"_past_{c}"), F.lit(0.0 if train_mean is None else train_mean)), Expanding("mean", c, past=True)


def time_series_features(
    df: DataFrame,
    panel: Panel,
    kinds: Mapping[str, str],
    train_means: Mapping[str, float],
    **limits,
) -> DataFrame:
    """Clock, rolling moments, filled difference, slope, rate and position relative to the rolling mean."""
    fills, expanding = {}, {}
    for c, kind in kinds.items():
        fills[c], need = past_fill(c, kind, train_means.get(c))
        if need:
            expanding[f"_past_{c}"] = need

    def local(d: DataFrame, w: WindowSpec) -> DataFrame:
        first = clock_columns()
        for c in kinds:
            first |= rolling_columns(c, w)
            first[f"_lag_{c}"] = F.coalesce(F.lag(c, 1).over(w), fills[c])
            first[f"_rm5_{c}"] = F.avg(c).over(back(w, 5))
            first[f"_fill_{c}"] = F.coalesce(F.col(c), fills[c])
        d = d.select("*", *[v.alias(k) for k, v in first.items()])
        second = {}
        for c in kinds:
            rm5 = F.col(f"{c}_rolling_mean_5")
            step = F.col(f"_fill_{c}") - F.col(f"_lag_{c}")
            second[f"{c}_diff_1"] = step
            second[f"{c}_slope_5"] = F.coalesce((rm5 - F.lag(rm5, 4).over(w)) / 5.0, F.lit(0.0))
            second[f"{c}_rate_1"] = step / (F.abs(F.col(f"_fill_{c}")) + 1.0)
            second[f"{c}_rel_to_mean_5"] = X.relative_to(F.col(c), F.col(f"_rm5_{c}"))
        d = d.select("*", *[v.alias(k) for k, v in second.items()])
        return d.drop(*[f"{p}_{c}" for c in kinds for p in ("_lag", "_rm5", "_fill", "_past")])

    return sequence_features(df, panel, local, 8, expanding, **limits)


# Names the feature schema is generated from.
TS_SUFFIXES = (
    "_rolling_mean_3", "_rolling_std_3", "_rolling_mean_5", "_rolling_std_5", "_diff_1", "_slope_5", "_rate_1",
)
CONTEXT_SUFFIXES = ("_rel_to_mean_5",)
CLOCK_NAMES = ("timestep_index", "normalized_time", "cold_start_flag", "is_scenario_boundary")


def feature_names(base: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> list[str]:
    """The feature schema of a panel: raw columns, clock, per-column suffixes, pair interactions."""
    names = [*base, *CLOCK_NAMES]
    names += [c + s for c in base for s in (*TS_SUFFIXES, *CONTEXT_SUFFIXES)]
    for a, b in pairs:
        names += [f"inter_{a}_x_{b}", f"ratio_{a}_to_{b}", f"diff_{a}_{b}", f"logprod_{a}_{b}", f"bucket_{a}_x_{b}"]
    return list(dict.fromkeys(names))


def pair_features(a: str, b: str, edges: Mapping[str, Sequence[float]] | None = None) -> dict[str, Column]:
    """Product, ratio, difference, log-product and (with fitted edges) the 5x5 cell of two sensors."""
    x, y = F.col(a), F.col(b)
    out = {
        f"inter_{a}_x_{b}": x * y,
        f"ratio_{a}_to_{b}": F.coalesce(X.ratio(x, y, 1e-9), F.lit(0.0)),
        f"diff_{a}_{b}": x - y,
        f"logprod_{a}_{b}": F.coalesce(F.log1p(F.abs(x * y)), F.lit(0.0)),
    }
    if edges:
        out[f"bucket_{a}_x_{b}"] = X.right_closed_bin(x, edges[a]) * 5 + X.right_closed_bin(y, edges[b])
    return out


def rolling_rank(values: Column, current: Column) -> Column:
    """Average-tie percentile rank of ``current`` among the collected frame values."""
    less = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v < current, 1).otherwise(0))
    same = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v == current, 1).otherwise(0))
    return (less + (same + 1) / 2.0) / F.size(values)
