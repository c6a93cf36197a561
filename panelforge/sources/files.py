"""Typed readers, partitioned tables, prediction sinks, run registry and stage contracts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window as W

from panelforge.operators.prefix import prefix_scan
from panelforge.session import cut_lineage, ensure_checkpoint_dir


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run's files, beside the checkpoints, where every executor can reach it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a stated schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_panel(fact: DataFrame, layout: DataFrame, key: str, target: tuple[str, str]) -> DataFrame:
    """Fact rows with the target renamed and the layout dimension attached."""
    return fact.withColumnRenamed(*target).join(layout, key, "left")


def downcast(df: DataFrame) -> DataFrame:
    """64-bit numbers to 32 bits, for storage; computing stays in 64 bits. Integers with a value beyond 32 bits keep theirs."""
    whole = [c for c, t in df.dtypes if t == "bigint"]
    fits = {}
    if whole:
        ends = df.agg(*[F.max(F.greatest(F.col(c), -1 - F.col(c))).alias(c) for c in whole]).first()
        fits = {c: ends[c] is None or ends[c] < 1 << 31 for c in whole}
    kind = lambda c, t: "float" if t == "double" else "int" if fits.get(c) else t
    return df.select(*[F.col(c).cast(kind(c, t)).alias(c) for c, t in df.dtypes])


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by the order key: a repeatable short run, unlike a bare limit."""
    return df.orderBy(order).limit(n)


def save_table(df: DataFrame, path: str, run_id: str) -> None:
    """One partition per run, so a reader of one run touches only its files."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def load_table(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id") == run_id).drop("run_id")


class StageInputMissing(RuntimeError):
    pass


def require(df: DataFrame, columns: Iterable[str], stage: str) -> DataFrame:
    """Stage contract: the input has the columns and at least one row."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise StageInputMissing(f"{stage}: missing columns {missing}")
    if df.isEmpty():
        raise StageInputMissing(f"{stage}: input is empty")
    return df


# --- submission ------------------------------------------------------------------------------------------------


def build_submission(preds: DataFrame, key: str = "id", pred: str = "pred") -> DataFrame:
    """Three decimals (half to even), never negative."""
    return preds.select(key, F.greatest(F.bround(F.col(pred).cast("double"), 3), F.lit(0.0)).alias(pred))


def submission_errors(sub: DataFrame, sample: DataFrame, key: str = "id", pred: str = "pred") -> DataFrame:
    """One row of counts, all zero when the submission honours its contract."""
    missing = sample.join(sub, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    unknown = sub.join(sample, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    repeated = sub.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).scalar()
    p = F.col(pred)
    own = sub.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(p.isNull() | F.isnan(p)).alias("n_null"),
        F.count_if(F.abs(p) == float("inf")).alias("n_infinite"),
        F.count_if(p < 0).alias("n_negative"),
    )
    return own.withColumn("n_missing", missing).withColumn("n_unknown", unknown).withColumn("n_repeated", repeated)


def order_mismatches(sub: DataFrame, sample: DataFrame, key: str = "id", sub_pos: str = "pos", sample_pos: str = "pos") -> Column:
    """How many rows stand at another position than in the sample, as a scalar."""
    a = sub.select(key, F.col(sub_pos).alias("_a"))
    b = sample.select(key, F.col(sample_pos).alias("_b"))
    return a.join(b, key).agg(F.count_if(F.col("_a") != F.col("_b")).alias("n")).scalar()


def with_positions(scan: DataFrame, name: str = "pos") -> DataFrame:
    """Rows straight from a file reader, with their place from 0: files by name, then as they stand in the file.

    A block of a file lies in one task, so a row's place in it is the difference of two of the task's row numbers; places of blocks are
    running totals of their counts. No rows are sorted or brought together.
    """
    at = ["_file", "_start"]
    columns = scan.columns
    rows = cut_lineage(scan.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")))
    blocks = rows.groupBy(*at).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = prefix_scan(blocks, [], at, sums=["_n"]).select(*at, "_first", (F.col("cum__n") - F.col("_n")).alias("_before"))
    return rows.join(before, at).select(*columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name))


def submission_layout_errors(sub: DataFrame, sample: DataFrame, key: str = "id") -> DataFrame:
    """One row: columns the submission lacks, has beyond the sample's or in another type, and rows at another place. Both come straight from a file reader."""
    want, have = dict(sample.dtypes), dict(sub.dtypes)
    listed = lambda names: F.lit(",".join(sorted(names)))
    shared = [c for c in want if c in have]
    moved = F.lit(None).cast("long")
    if key in shared:
        moved = order_mismatches(with_positions(sub.select(key)), with_positions(sample.select(key)), key)
    return sample.sparkSession.range(1).select(
        listed(set(want) - set(have)).alias("missing_columns"), listed(set(have) - set(want)).alias("extra_columns"),
        listed(c for c in shared if want[c] != have[c]).alias("retyped_columns"), moved.alias("n_moved"),
    )


# --- run registry ------------------------------------------------------------------------------------------------


def upsert_runs(registry: DataFrame, new: DataFrame, key: str = "run_id", stamp: str = "ts") -> DataFrame:
    """The latest record of every run."""
    both = registry.unionByName(new)
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(stamp)))
    return both.withColumn("_n", newest).where("_n = 1").drop("_n")


def best_run(registry: DataFrame, metric: str = "mae") -> DataFrame:
    return registry.where("status = 'APPROVED'").agg(F.min_by("run_id", F.struct(metric, "run_id")).alias("run_id"), F.min(metric).alias(metric))


def append_history(history: DataFrame, new: DataFrame, stamp: str = "ts", keep: int = 100) -> DataFrame:
    """The last ``keep`` records."""
    return history.unionByName(new).orderBy(F.desc(stamp)).limit(keep)


FOLD_STATS_SHAPES = ("array<struct<fold:int,mae:double>>", "array<double>", "struct<mean:double>")


def runs_from_json(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(run_id, mae, n_folds, fold_mean) from documents {"runs": [...]}, whatever shape fold_stats has.

    ``fold_stats`` is read as text and parsed by the shape it turns out to have: objects with a mae, plain
    numbers, or one object with a mean.  Older records hold ``mean_mae`` instead of ``metrics.mae``.
    """
    run = "struct<run_id:string,mean_mae:double,metrics:struct<mae:double>,fold_stats:string>"
    docs = spark.read.schema(f"runs array<{run}>").option("multiLine", not one_per_line).json(path)
    r = docs.select(F.explode("runs").alias("r")).select("r.*")
    objects, numbers, single = (F.from_json("fold_stats", s) for s in FOLD_STATS_SHAPES)
    from_objects = F.transform(objects, lambda x: x["mae"])
    is_objects = F.col("fold_stats").startswith("[{")
    is_list = F.col("fold_stats").startswith("[")
    maes = F.when(is_objects, from_objects).when(is_list, numbers).otherwise(F.array(single["mean"]))
    return r.select(
        "run_id",
        F.coalesce("metrics.mae", "mean_mae").alias("mae"),
        F.size(maes).alias("n_folds"),
        (F.aggregate(maes, F.lit(0.0), lambda s, x: s + x) / F.size(maes)).alias("fold_mean"),
    )


def explode_cases(logs: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows from records that hold parallel arrays."""
    rest = [c for c in logs.columns if c not in arrays]
    return logs.select(*rest, F.explode(F.arrays_zip(*[F.col(a) for a in arrays])).alias("z")).select(*rest, *[F.col(f"z.{a}").alias(a) for a in arrays])
