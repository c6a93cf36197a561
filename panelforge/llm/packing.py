"""Packing by minimum bin slack: each training sequence takes the remaining lengths that fill it most closely.

Only the histogram of piece lengths (at most ``capacity`` rows) is needed to decide: documents of equal length are
interchangeable. The plan is made on that histogram: take the longest remaining piece, find by a bitset subset-sum
over the remaining counts the sums that the others reach, walk back from the best one, and use that filling as often as
the counts allow. Pieces then find their place by their rank among pieces of the same length.

Whole pieces that no exact filling takes are cut into blocks of ``BLOCK`` ids and filled again, then with the least slack.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm.common import numbered, ship_package, text_batches, written
from panelforge.llm.pieces import encoder

BLOCK = 256
ENCODE_BYTES = 1 << 20


def best_filling(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` that a sub-multiset of ``counts`` reaches, and that sub-multiset.

    Bit s of ``reach`` says that sum s can be reached. A length with count c enters in lots of 1, 2, 4, ... pieces, so
    that every number up to c can be taken; the walk back undoes the lots from the last to the first.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        lot = 1
        while left > 0:
            take = min(lot, left)
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, lot = left - take, lot * 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return best, used


def plan(counts: dict[int, int], capacity: int, exact: bool) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fillings with how often each is used, and the counts left over (only if ``exact``: those without an exact filling)."""
    left, fillings, over = {k: v for k, v in counts.items() if v}, [], {}
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        total, used = best_filling(rest, capacity - longest)
        if exact and longest + total != capacity:
            over[longest] = left.pop(longest)
            continue
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        fillings.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return fillings, over


def places(fillings: list[tuple[dict[int, int], int]], first: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank from, rank to, first sequence, pieces a sequence, offset in it), and the next free sequence."""
    rows, taken = [], {}
    for used, times in fillings:
        offset = 0
        for length in sorted(used, reverse=True):
            lo = taken.get(length, 0)
            taken[length] = lo + used[length] * times
            rows.append((length, lo, taken[length], first, used[length], offset))
            offset += length * used[length]
        first += times
    return rows, first


def _lengths(path: str, end_id: int | None, capacity: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_batches(it, "text", ENCODE_BYTES):
            ids, lens = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                lens = lens + 1
            raw, at, pieces, blocks = memoryview(ids.astype("<u4").tobytes()), 0, [], []
            for n in lens.tolist():
                own = raw[4 * at : 4 * (at + n)]
                pieces.append([zlib.crc32(own[4 * a : 4 * (a + capacity)]) for a in range(0, n, capacity)])
                tail = own[4 * (n - n % capacity) :]
                blocks.append([zlib.crc32(tail[4 * a : 4 * (a + BLOCK)]) for a in range(0, n % capacity, BLOCK)])
                at += n
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lens), pa.array(pieces, kind), pa.array(blocks, kind)], names=["doc_id", "doc_tokens", "crcs", "blocks"]
            )

    return run


_PLACES = "length int, lo long, hi long, first long, per long, at long"


def _placed(pieces: DataFrame, rows: list[tuple], spark: SparkSession) -> DataFrame:
    """``pieces`` (with length and rank) with their sequence and offset. The rows are a few for each length below the capacity."""
    p = F.broadcast(spark.createDataFrame(rows, _PLACES))
    hit = pieces.join(p, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    own = F.col("rank") - F.col("lo")
    return hit.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first") + F.floor(own / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(own, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """All token ids of ``docs`` in sequences of at most ``capacity`` ids, one row per piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). Documents longer than a sequence are cut into
    full sequences and a remainder. A null or empty text has only its end id (no piece at all without one). Every row of
    ``docs`` is a document of its own, also with a repeated or null id; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lens = written(read.mapInArrow(_lengths(vocabulary, end_id, capacity), "doc_id long, doc_tokens long, crcs array<long>, blocks array<long>"), "pack-lengths")
    cut = lens.select("doc_id", "doc_tokens", "blocks", F.posexplode("crcs").alias("_k", "ids_crc32"))
    start = F.col("_k").cast("long") * capacity
    pieces = cut.select(
        "doc_id", "doc_tokens", start.alias("start"), "ids_crc32", F.least(F.lit(capacity), F.col("doc_tokens") - start).cast("int").alias("length"), "blocks"
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole, over = plan(counts, capacity, exact=True)
    rows, free = places(whole, 0)

    # Left-over remainders: their blocks are new pieces, whose ranks follow from the remainder's rank.
    small: dict[int, int] = {}
    bases = []
    for length, n in over.items():
        used = counts[length] - n
        blocks, tail = divmod(length, BLOCK)
        bases.append((length, used, small.get(BLOCK, 0), small.get(tail, 0)))
        small[BLOCK] = small.get(BLOCK, 0) + blocks * n
        if tail:
            small[tail] = small.get(tail, 0) + n
    rows2, _ = places(plan(small, capacity, exact=False)[0], free)

    ranked = numbered(pieces, ["length"], ["doc_id", "start"], "rank")
    out = _placed(ranked, rows, spark)
    if not bases:
        return out
    b = F.broadcast(spark.createDataFrame(bases, "length int, _used long, _block long, _tail long"))
    rest = ranked.join(b, "length").where(F.col("rank") >= F.col("_used")).withColumn("_nth", F.col("rank") - F.col("_used"))
    rest = rest.select("*", F.posexplode("blocks").alias("_j", "_crc"))
    at = F.col("_j").cast("long") * BLOCK
    size = F.least(F.lit(BLOCK), F.col("length") - at).cast("int")
    rank = F.when(size == BLOCK, F.col("_block") + F.col("_nth") * F.floor(F.col("length") / BLOCK) + F.col("_j")).otherwise(F.col("_tail") + F.col("_nth"))
    cut = rest.select("doc_id", "doc_tokens", (F.col("start") + at).alias("start"), F.col("_crc").alias("ids_crc32"), size.alias("length"), rank.cast("long").alias("rank"))
    return out.unionByName(_placed(cut, rows2, spark))
