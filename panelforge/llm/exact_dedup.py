"""Exact duplicates by a split of heavy hitters: frequent digests are settled where they stand, the rest is shuffled.

A Misra-Gries summary names the digests that may hold a share of all rows; one exact pass over digests counts them and
finds their winners. Those few winners are broadcast, so that copies of a hot text never meet in one task. All other
digests, each below the share, are grouped by an ordinary shuffle of (digest, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import fresh, frequent, without, written

#: A digest with at least this share of the rows counts as frequent: at most 1 / SUPPORT winners are broadcast.
SUPPORT = 1e-3


def winners(digests: DataFrame, digest: str, id_col: str, support: float = SUPPORT) -> DataFrame:
    """(digest, largest id, rows, rows with that id) of each digest that really holds ``support`` of the rows."""
    total = digests.count()
    found = digests.join(F.broadcast(frequent(digests, digest, support)), digest)
    exact = found.groupBy(digest).agg(F.max(id_col).alias("_keep"), F.count(F.lit(1)).alias("_rows"))
    exact = written(exact.where(F.col("_rows") >= F.lit(max(2, int(support * total)))), "dedup-winners")
    ties = digests.join(F.broadcast(exact), digest).where(F.col(id_col).eqNullSafe(F.col("_keep"))).groupBy(digest).agg(F.count(F.lit(1)).alias("_ties"))
    return written(exact.join(F.broadcast(ties), digest), "dedup-winners")


def mark_copies(df: DataFrame, digest: Column, id_col: str, names: tuple[str, str, str, str], support: float = SUPPORT) -> DataFrame:
    """``df`` with four columns ``names``: digest, id of the row that stays, rows of the group, whether this row stays.

    Of rows with an equal digest the largest id stays. ``digest`` must not be null (give null content a digest of its own).
    A null id loses against any other; if all ids of a group are null, the id that stays is null. Of rows that repeat the
    winning id, one stays. Columns of ``df`` named like the new ones (whatever the case) are replaced, others are kept as they
    are; an empty table stays empty.
    """
    name, keep_name, rows_name, kept_name = names
    df = without(df.withColumn(key := fresh(df, "_key")[0], digest), *names)
    digest = F.col(key)
    row, keep, rows, ties, rank = fresh(df, "_row", "_keep", "_rows", "_ties", "_rank")
    digests = written(df.select(F.col(id_col), digest.alias(name)), "dedup-digests")
    # Renamed, so that no column of df can clash with it.
    top = winners(digests, name, id_col, support).select(F.col(name), F.col("_keep").alias(keep), F.col("_rows").alias(rows), F.col("_ties").alias(ties))
    full = df.withColumn(name, digest)
    if top.where(F.col(ties) > 1).head(1):
        # Rows that repeat a frequent winner: store all rows with a number, and let the number break the tie.
        full = written(full.withColumn(row, F.monotonically_increasing_id()), "dedup-rows")
        best = full.join(F.broadcast(top.select(name, keep)), name).where(F.col(id_col).eqNullSafe(F.col(keep)))
        best = best.groupBy(name).agg(F.max(row).alias("_best"))
        top = top.join(F.broadcast(best), name).withColumnRenamed("_best", ties + "_row")
        settled = F.col(id_col).eqNullSafe(F.col(keep)) & (F.col(row) == F.col(ties + "_row"))
    else:
        settled = F.col(id_col).eqNullSafe(F.col(keep))
    split = full.join(F.broadcast(top), name, "left")
    cols = [F.col(f"`{c}`") for c in df.columns if c != key]
    hot = split.where(F.col(rows).isNotNull()).select(*cols, name, F.col(keep).alias(keep_name), F.col(rows).alias(rows_name), settled.alias(kept_name))
    group = W.partitionBy(name)
    rest = split.where(F.col(rows).isNull()).select(
        *cols,
        name,
        F.max(id_col).over(group).alias(keep_name),
        F.count(F.lit(1)).over(group).alias(rows_name),
        (F.row_number().over(group.orderBy(F.col(id_col).desc_nulls_last())) == 1).alias(kept_name),
    )
    return hot.unionByName(rest)


#: Names of the columns that ``exact_dedup`` adds.
MARKS = ("text_sha256", "keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str, str] = MARKS, support: float = SUPPORT) -> DataFrame:
    """``docs`` with its texts' SHA-256 and the columns of ``mark_copies``; null text equals empty text."""
    return mark_copies(docs, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), id_col, names, support)
