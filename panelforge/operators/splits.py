"""Time-aware folds, group folds, seeded splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelforge.operators.prefix import row_positions


def scenario_order(df: DataFrame, sid: str = "sid", num: str = "id") -> DataFrame:
    """(sid, first_id, pos): sequences in the order of their smallest id."""
    first = df.groupBy(sid).agg(F.min(num).alias("first_id"))
    return row_positions(first, [], ["first_id"], "pos")


def chunk_of(pos: Column, n: Column, chunks: int) -> Column:
    """Chunk of position ``pos`` when ``n`` items are cut into ``chunks`` parts whose sizes differ by at most one,
    the longer ones first."""
    size, longer = F.floor(n / chunks), n % chunks
    cut = longer * (size + 1)
    return F.when(pos < cut, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - cut) / F.greatest(size, F.lit(1)))).cast("int")


def scenario_chunks(df: DataFrame, n_folds: int = 5, sid: str = "sid", num: str = "id") -> DataFrame:
    """(sid, first_id, pos, chunk) with ``n_folds`` + 2 chunks: the first two only ever train."""
    ordered = scenario_order(df, sid, num)
    n = df.agg(F.count_distinct(sid).alias("n")).scalar()
    return ordered.withColumn("chunk", chunk_of(F.col("pos"), n, n_folds + 2))


def time_aware_folds(df: DataFrame, n_folds: int = 5, sid: str = "sid", num: str = "id") -> DataFrame:
    """Rows with their chunk.  Fold f trains on chunks up to f + 1 and validates on chunk f + 2."""
    return df.join(scenario_chunks(df, n_folds, sid, num).select(sid, "chunk"), sid)


def fold_sides(chunk: Column, n_folds: int = 5) -> Column:
    """The (fold, role) pairs a row of this chunk takes part in, as an array of structs."""
    pairs = []
    for f in range(n_folds):
        role = F.when(chunk <= f + 1, F.lit("train")).when(chunk == f + 2, F.lit("val"))
        pairs.append(F.struct(F.lit(f).alias("fold"), role.alias("role")))
    return F.filter(F.array(*pairs), lambda p: p["role"].isNotNull())


def fold_ranges(rows: DataFrame, n_folds: int = 5, num: str = "id") -> DataFrame:
    """(fold, n_train, n_val, train_max, val_min, leaks): aggregated per chunk first, so folds cost nothing."""
    per = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max(num).alias("hi"), F.min(num).alias("lo"))
    sides = per.select("n", "hi", "lo", F.inline(fold_sides(F.col("chunk"), n_folds)))
    train, val = F.col("role") == "train", F.col("role") == "val"
    out = sides.groupBy("fold").agg(
        F.sum(F.when(train, F.col("n"))).alias("n_train"),
        F.sum(F.when(val, F.col("n"))).alias("n_val"),
        F.max(F.when(train, F.col("hi"))).alias("train_max"),
        F.min(F.when(val, F.col("lo"))).alias("val_min"),
    )
    return out.withColumn("leaks", F.col("train_max") >= F.col("val_min"))


def assert_no_leak(rows: DataFrame, n_folds: int = 5, num: str = "id") -> None:
    """Fail when any training id reaches into its validation chunk."""
    bad = fold_ranges(rows, n_folds, num).where("leaks").select("fold", "train_max", "val_min").collect()
    if bad:
        raise AssertionError("temporal leak: " + ", ".join(f"fold {b.fold}: {b.train_max} >= {b.val_min}" for b in bad))


def key_hash(*cols: Column, seed: int = 42, digits: int = 8) -> Column:
    """The first hex digits of the MD5 of the key and the seed, as a number: a hash that other engines can compute too."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def unit_hash(*cols: Column, seed: int = 42) -> Column:
    """A seeded, order-free pseudo-random number in [0, 1) per row."""
    return key_hash(*cols, seed=seed) / float(1 << 32)


def hash_fold(k: int, *cols: Column, seed: int = 42) -> Column:
    """Fold number by hash: the same row (or group key) always lands in the same fold."""
    return F.pmod(key_hash(*cols, seed=seed), F.lit(k)).cast("int")


#: Ranges of the hashes that positions are counted in.
HASH_RANGES = 2048


def stratified_folds(df: DataFrame, label: str, k: int, key: str, seed: int = 42, keys: DataFrame | None = None) -> DataFrame:
    """Folds in which every class is spread evenly: position inside the class, in hash order, modulo k.

    Hashes are spread evenly, so their ranges are known beforehand: the rows are shuffled once, and the positions before a range come
    from one count a range, of ``keys`` (label and key of the same rows) where those are cheaper to read.
    """
    def ranged(rows: DataFrame) -> DataFrame:
        h = key_hash(F.col(key), seed=seed, digits=13)
        known = {"_known": F.col(label).isNotNull(), "_class": F.coalesce(F.col(label).cast("string"), F.lit(""))}  # NULL is a class like any other
        return rows.withColumns(known | {"_h": h, "_range": F.floor(h / float(16**13 // HASH_RANGES)).cast("int")})

    counts = ranged((df if keys is None else keys).select(label, key)).groupBy("_known", "_class", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_known", "_class").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_known", "_class", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # HASH_RANGES rows a class
    place = F.row_number().over(W.partitionBy("_known", "_class", "_range").orderBy("_h", key)) - 1
    # As many parts as the shuffle has, not fewer: what reads the result needs a share for each core.
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = ranged(df).repartition(parts, "_known", "_class", "_range").withColumn("_pos", place).join(before, ["_known", "_class", "_range"])
    return placed.withColumn("fold", F.pmod(F.col("_pos") + F.col("_before"), F.lit(k)).cast("int")).select(*df.columns, "fold")


def hash_sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash: a capped sample that does not depend on partitioning."""
    return df.withColumn("_h", key_hash(*[F.col(k) for k in keys], seed=seed, digits=13)).orderBy("_h", *keys).limit(n).drop("_h")


def stratified_sample(df: DataFrame, stratum: Sequence[str], share: float, key: str, seed: int = 42) -> DataFrame:
    """``share`` of every stratum (NULL is one too), rounded down, by hash order inside the stratum."""
    keyed = df.withColumn("_h", key_hash(F.col(key), seed=seed, digits=13))
    sizes = df.groupBy(*[F.col(c).alias(f"_s_{c}") for c in stratum]).agg(F.count(F.lit(1)).alias("_n"))
    placed = row_positions(keyed, list(stratum), ["_h", key], "_pos")
    placed = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in stratum])
    return placed.where(F.col("_pos") < F.floor(F.col("_n") * share)).select(*df.columns)


def top_share(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The highest-scoring ``share`` of rows (at least one), ties by key, without a global sort in one task."""
    ranked = row_positions(df.withColumn("_down", -F.col(score)), [], ["_down", key], "_pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.where(F.col("_pos") < F.greatest(F.lit(1), F.floor(n * share))).drop("_down", "_pos")
