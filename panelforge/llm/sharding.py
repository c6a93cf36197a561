"""Shards by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has a hash u in (0, 1) and the score -weight / ln(u); a record goes to the shard with the largest
score. A record's scores do not depend on other shards, so one more shard takes records only into itself, and a changed
weight moves only what must move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.common import numbered, written


def score(key: Column, shard: int, weight: float) -> Column:
    """The rendezvous score from the upper 52 bits of a 64-bit hash of the key and the shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(-float(weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard number of ``key`` among ``len(weights)`` shards; equal scores go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    best = F.greatest(*[F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]) if len(weights) > 1 else None
    return -best["i"] if best is not None else F.lit(0)


def shard_records(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``shard`` depends on the id and ``weights`` only (a null id is a key like any other); ``grown_shard`` is the shard under
    ``grown``, null without it. ``size`` is the text's UTF-8 bytes plus 1 (null: 1; its CRC is that of the empty text).
    ``slot`` counts the rows of a shard from 0 without gaps; its order has no meaning. Rows with a repeated id share a
    shard and have slots of their own. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights).cast("int").alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    out = numbered(written(rows, "shards"), ["shard"], ["doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")
