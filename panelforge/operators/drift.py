"""How two populations differ, feature by feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.operators.prefix import melt, prefix_scan, value_counts


def side_cdf(df: DataFrame, cols: Sequence[str] | Mapping[str, Column], side: Column, group: Sequence[str] = ()) -> DataFrame:
    """(group..., feature, value, fa, fb): both empirical distribution functions at every distinct value.

    ``side`` true is population A, false is B, NULL rows are left out.  One long-form aggregate and one prefix
    scan serve all features together.
    """
    return cdf_of_counts(side_counts(df, cols, side, group), [*group, "feature"])


def cdf_of_counts(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distribution functions of a (key..., value, a, b) count table."""
    key = list(key)
    run = prefix_scan(counts, key, ["value"], sums=["a", "b"])
    totals = run.groupBy(*key).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return run.join(totals, key).select(
        *key,
        "value",
        F.try_divide(F.col("cum_a").cast("double"), F.col("na").cast("double")).alias("fa"),
        F.try_divide(F.col("cum_b").cast("double"), F.col("nb").cast("double")).alias("fb"),
        "na",
        "nb",
    )


def ks_of_cdf(cdf: DataFrame, key: Sequence[str] = ("feature",)) -> DataFrame:
    return cdf.groupBy(*key).agg(
        F.max(F.abs(F.col("fa") - F.col("fb"))).alias("ks_stat"), F.max("na").alias("n_a"), F.max("nb").alias("n_b")
    )


def ks_table(df: DataFrame, cols, side: Column, group: Sequence[str] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per (group, feature)."""
    return ks_of_cdf(side_cdf(df, cols, side, group), [*group, "feature"])


#: Bins of a feature in which both distribution functions are bounded before any value is looked at.
KS_BINS = 512


def ks_within(df: DataFrame, cols: Sequence[str], side: Column, limit: float) -> set[str]:
    """Features whose ``ks_stat`` is at most ``limit``, as ``ks_table`` would give it.

    The two functions are known at the ends of bins, and between them neither leaves its values there. Only the values of
    bins that this leaves open are counted and ordered, so all values of a feature are shuffled only if it has few.
    """
    cols, rows = list(cols), df.withColumn("_a", side).where(F.col("_a").isNotNull())
    shares = F.array(*[F.lit(i / KS_BINS) for i in range(1, KS_BINS)])
    cuts = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10 * KS_BINS)).alias(c) for c in cols]).first().asDict()
    edges = {c: [-float("inf"), *sorted({x for x in cuts[c] or [] if abs(x) < float("inf")}), float("inf")] for c in cols}
    cut = Bucketizer(splitsArray=[e if len(e) > 2 else [e[0], 0.0, e[1]] for e in edges.values()], inputCols=[f"_v{i}" for i in range(len(cols))], outputCols=[f"_b{i}" for i in range(len(cols))], handleInvalid="keep")
    binned = cut.transform(rows.select("_a", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)]))
    # NaN sorts last and has the bin that is kept for invalid values; NULL is left out.
    cells = F.explode(F.array(*[F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").cast("int").alias("b"), F.col(f"_v{i}").alias("value"))) for i in range(len(cols))])).alias("c")
    long = binned.select("_a", cells).where("c IS NOT NULL").select("_a", "c.f", "c.b", "c.value")
    counts = long.groupBy("f", "b").agg(F.count_if("_a").alias("a"), F.count_if(~F.col("_a")).alias("z")).collect()
    within, waiting, starts = set(), {}, []
    for i, c in enumerate(cols):
        bins = sorted((x.b, x.a, x.z) for x in counts if x.f == i)
        na, nz = sum(x[1] for x in bins), sum(x[2] for x in bins)
        if not (na and nz):
            continue
        a = z = 0
        known, open_bins = True, []
        for b, x, y in bins:
            known = known and abs((a + x) / na - (z + y) / nz) <= limit
            if max((a + x) / na - z / nz, (z + y) / nz - a / na) > limit:
                open_bins.append((i, b, a, z, na, nz))
            a, z = a + x, z + y
        if known and not open_bins:
            within.add(c)
        elif known:
            waiting[i] = c
            starts += open_bins
    if starts:
        at = F.broadcast(df.sparkSession.createDataFrame(starts, "f int, b int, a0 long, z0 long, na long, nz long"))  # at most KS_BINS rows a column
        values = value_counts(long.join(at, ["f", "b"]), ["f", "b", "a0", "z0", "na", "nz"], "value", a=F.count_if("_a"), z=F.count_if(~F.col("_a")))
        run = prefix_scan(values, ["f", "b", "a0", "z0", "na", "nz"], ["value"], sums=["a", "z"])
        gap = F.abs((F.col("a0") + F.col("cum_a")).cast("double") / F.col("na") - (F.col("z0") + F.col("cum_z")).cast("double") / F.col("nz"))
        within |= {waiting[x.f] for x in run.groupBy("f").agg(F.max(gap).alias("ks")).collect() if x.ks <= limit}
    return within


def ks_p_value(d: Column, n_a: Column, n_b: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided p-value: the Kolmogorov series at sqrt(n_a n_b / (n_a + n_b)) * d."""
    x = F.sqrt(n_a.cast("double") * n_b / (n_a + n_b)) * d
    series = sum(((-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x) for j in range(1, terms + 1))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def wasserstein(counts: DataFrame, key: Sequence[str] = ("feature",)) -> DataFrame:
    """Area between the two distribution functions of a (key..., value, a, b) count table.

    Between a value and the one before it both functions stand where the earlier value left them.
    """
    key = list(key)
    run = prefix_scan(counts, key, ["value"], sums=["a", "b"], before=["value"])
    totals = run.groupBy(*key).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    fa, fb = (F.col("cum_a") - F.col("a")) / F.col("na"), (F.col("cum_b") - F.col("b")) / F.col("nb")
    step = F.col("value") - F.col("before_value")
    return run.join(totals, key).groupBy(*key).agg(
        F.coalesce(F.sum(F.abs(fa - fb) * step), F.lit(0.0)).alias("distance")
    )


def side_counts(df: DataFrame, cols, side: Column, group: Sequence[str] = ()) -> DataFrame:
    """The count table behind ``side_cdf``: (group..., feature, value, a, b)."""
    long = melt(df.withColumn("_a", side).where(F.col("_a").isNotNull()), [*group, "_a"], cols)
    return value_counts(
        long, [*group, "feature"], "value", a=F.count_if(F.col("_a")), b=F.count_if(~F.col("_a"))
    )


def joint_bins(counts: DataFrame, bins: int) -> DataFrame:
    """(feature, bin, a, b): both sides on ``bins`` equal-width bins over their joint range (last bin closed)."""
    ranges = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9) * bins)
    return (
        counts.join(F.broadcast(ranges), "feature")  # one row per feature of the schema
        .withColumn("bin", F.least(at, F.lit(bins - 1)))
        .groupBy("feature", "bin")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )


def psi(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per feature; an empty bin weighs 1e-9."""
    cells = joint_bins(counts, bins)
    totals = counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    filled = grid.join(cells, ["feature", "bin"], "left").fillna(0, ["a", "b"])
    e, o = F.col("a") / F.col("na") + 1e-9, F.col("b") / F.col("nb") + 1e-9
    return filled.groupBy("feature").agg(F.sum((e - o) * F.ln(e / o)).alias("psi"))


def histogram_kl(counts: DataFrame, bins: int = 50) -> DataFrame:
    """sum p ln(p/q) over density histograms, each side binned on its own range, 1e-10 added to every bin."""
    sides = counts.select(
        "feature", "value", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("a").alias("n")), F.struct(F.lit("b").alias("s"), F.col("b").alias("n")))).alias("x")
    ).select("feature", "value", "x.s", "x.n").where("n > 0")
    ranges = sides.groupBy("feature", "s").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    cells = (
        sides.join(F.broadcast(ranges), ["feature", "s"])  # two rows per feature
        .withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)))
        .groupBy("feature", "s", "bin")
        .agg(F.sum("n").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    density = grid.join(cells, ["feature", "s", "bin"], "left").select(
        "feature", "bin", "s", (F.coalesce(F.col("n"), F.lit(0)) / (F.col("total") * width) + 1e-10).alias("d")
    )
    pq = density.groupBy("feature", "bin").agg(
        F.max(F.when(F.col("s") == "a", F.col("d"))).alias("p"), F.max(F.when(F.col("s") == "b", F.col("d"))).alias("q")
    )
    return pq.groupBy("feature").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def knee_threshold(drift: DataFrame, low: float = 0.03) -> DataFrame:
    """Cut-off on ``ks_stat`` where cumulative importance departs most from cumulative feature count.

    ``drift`` is feature metadata (feature, ks_stat, importance), one row per column, so a plain window serves.
    """
    everything = W.partitionBy(F.lit(0))
    run = everything.orderBy("ks_stat", "feature").rowsBetween(W.unboundedPreceding, 0)
    curve = drift.select(
        "feature",
        "ks_stat",
        F.sum("importance").over(run).alias("cum"),
        F.sum("importance").over(everything).alias("total"),
        F.row_number().over(everything.orderBy("ks_stat", "feature")).alias("i"),
        F.count(F.lit(1)).over(everything).alias("n"),
    )
    gap = F.abs(F.col("i") / F.col("n") - F.try_divide(F.col("cum"), F.col("total")))
    knee = F.max_by(F.col("ks_stat"), F.struct(F.round(gap, 12), -F.col("i")))
    p90, p75 = F.percentile("ks_stat", F.lit(0.9)), F.percentile("ks_stat", F.lit(0.75))
    return curve.agg(
        F.when(F.max("total") < 1e-9, p75)
        .otherwise(F.greatest(F.least(knee, p90), F.lit(low)))
        .alias("threshold"),
        knee.alias("knee"),
        p90.alias("p90"),
    )


def variance_ratio(df: DataFrame, cols: Sequence[str], side: Column) -> DataFrame:
    """(feature, var_a, var_b, ratio = b / (a + 1e-9)) in long form, one aggregate pass."""
    wide = df.agg(
        *[F.var_samp(F.when(side, F.col(c))).alias(f"a_{c}") for c in cols],
        *[F.var_samp(F.when(~side, F.col(c))).alias(f"b_{c}") for c in cols],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("var_a"), F.col(f"b_{c}").alias("var_b")) for c in cols])
    return wide.select(F.inline(cells)).withColumn("ratio", F.col("var_b") / (F.col("var_a") + 1e-9))


def stats_long(df: DataFrame, cols: Sequence[str], **stats) -> DataFrame:
    """(feature, stat...): ``stats`` maps a name to a function Column -> aggregate; one pass over ``df``."""
    wide = df.agg(*[f(F.col(c)).alias(f"{n}__{c}") for c in cols for n, f in stats.items()])
    cells = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}__{c}").alias(n) for n in stats]) for c in cols]
    return wide.select(F.inline(F.array(*cells)))
