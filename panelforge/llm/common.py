"""What several corpus operators share: reading, shipping code, written intermediate tables, frequent values, numbering."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from panelforge.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch between Spark and Python: long texts would make batches of many rows large.
ARROW_BATCH = "8m"


def ship_package(spark: SparkSession) -> None:
    """Prepare a session for the tasks of this subpackage.

    The package is sent to the executors once per application, so that tasks can import it anywhere; batches between Spark
    and Python are kept to ARROW_BATCH.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="spark-")
    target = os.path.join(folder, f"{root.name}_tasks.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there and a lost executor costs a re-read."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A stored table of keys with at most so many rows may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(stored: DataFrame) -> DataFrame:
    """``stored`` (a few short columns) marked for a broadcast if it has few rows; else left to an ordinary join."""
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names close to ``wanted`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns named like ``names``, whatever the case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def frequent(df: DataFrame, key: str, support: float) -> DataFrame:
    """(key) of the values that hold at least ``support`` of the rows, with some others: at most 1 / support rows.

    A Misra-Gries summary: each task keeps a bounded set of counters, and the summaries are merged.
    """
    found = df.select(key).freqItems([key], support).toDF("_items")
    return found.select(F.explode("_items").alias(key)).where(F.col(key).isNotNull())


def text_batches(it: Iterator[pa.RecordBatch], text: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text (one longer text stands alone)."""
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def give_back_memory() -> None:
    """Return what earlier tasks of a reused Python worker have freed, but still hold, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


#: Rows that one task numbers, as long as that makes no more than MOST_BUCKETS buckets.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 100_000


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Gapless ``name`` from 0 within each group (group values are not null), without one task per group.

    ``df`` must be stored (its rows and their partitions may not change between two reads). A group's rows are dealt
    evenly into buckets by a row number, so no key of the data can make a bucket large; each bucket is numbered on its own
    and starts where the buckets before it end. Groups must be few (callers bound them): the bucket starts, at most
    MOST_BUCKETS and one for each group, are broadcast.
    """
    group = list(group)
    row, bucket, start, local, n = fresh(df, "_row", "_bucket", "_start", "_local", "_n")
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(n))
    total = sizes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    buckets = F.ceil(F.col(n) / max(BUCKET_ROWS, total // MOST_BUCKETS)).cast("long")
    dealt = (
        df.withColumn(row, F.monotonically_increasing_id())
        .join(F.broadcast(sizes), group)
        .withColumn(bucket, F.pmod(F.xxhash64(row), buckets))
        .drop(n)
    )
    counts = dealt.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias(start))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    inner = dealt.withColumn(local, F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order, row)))
    placed = inner.join(F.broadcast(offsets), [*group, bucket])
    return placed.withColumn(name, F.col(start) + F.col(local) - 1).drop(bucket, start, local, row)
