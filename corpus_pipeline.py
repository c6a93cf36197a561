"""From documents to packed training sequences: language, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A stage works on
every document that the stages before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge.llm.common import broadcast_if_small, fresh, table, written
from panelforge.llm.decontaminate import drop_leaks
from panelforge.llm.exact_dedup import exact_dedup
from panelforge.llm.language_id import identify, train
from panelforge.llm.packing import pack
from panelforge.llm.signature_join import similar_groups

#: SQL cannot express language identification or token ids, so the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without letters and texts far from every language go.

    Null and empty texts have no letter and go; rows without a label are judged like any other. Repeated rows are each judged, with equal
    results; of equally near languages the first one by name counts. An empty table, or one without any labelled text, leaves no rows.
    """
    names = tuple(fresh(docs, "_lang", "_score", "_rejected"))
    found = identify(docs, train(docs), names=names)
    return found.where(~F.col(names[2])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays.

    Null text equals empty text, so one of all null and empty texts stays. A null id loses against any other; of rows that repeat the
    largest id one stays. An empty table stays empty.
    """
    names = tuple(fresh(docs, "_digest", "_keep", "_copies", "_kept"))
    return exact_dedup(docs, names=names).where(names[3]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles connect, one stays.

    Documents are told apart by ``with_key``; of a group the one with the smallest key stays, so ties cannot occur. Null, empty and blank
    texts have no shingles and stay. Null and repeated ids do no harm; of rows that repeat id and text one stays. An empty table
    stays empty.
    """
    key = fresh(docs, "_document")[0]
    keyed = with_key(docs, key)
    groups = written(similar_groups(keyed, k=5, percent=80, id_col=key), "pipeline-groups")
    gone = groups.where(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = keyed.join(gone, key, "left_anti")
    if groups.groupBy(key).count().where("count > 1").head(1):
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)


def with_key(docs: DataFrame, key: str, first: Column | None = None) -> DataFrame:
    """``docs`` with a long column ``key`` that differs between different (doc_id, text).

    It is a 64-bit hash, ``first``. Where different documents share it, which some of 10^10 do, those take a second hash in its place.
    """
    first = F.xxhash64("doc_id", "text") if first is None else first
    second = F.xxhash64(F.lit(1), "doc_id", "text")
    of_key = docs.select(first.alias("_first"), second.alias("_second")).groupBy("_first").agg(F.min("_second").alias("_least"), F.max("_second").alias("_most"))
    shared = written(of_key.where("_least <> _most").select(F.col("_first").alias(fresh(docs, "_shared", key)[0])), "pipeline-shared-keys")
    if not shared.head(1):
        return docs.withColumn(key, first)
    met = F.col(shared.columns[0])
    keyed = docs.withColumn(key, first)
    return keyed.join(broadcast_if_small(shared), F.col(key) == met, "left").withColumn(key, F.when(met.isNull(), F.col(key)).otherwise(second)).drop(shared.columns[0])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go.

    Null and empty texts, of documents or of items, match nothing and stay. Ids are not read; repeated rows share their fate; an overlap of
    exactly the limit counts as a leak. An empty table stays empty, and an empty benchmark drops nothing.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null text equals empty text: such a document is its end id alone. Rows that repeat an id are packed each; equally long pieces are
    placed in an order that does not change the padding. An empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", decontaminate),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
