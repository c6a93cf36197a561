"""Queries beside their SQL, and the pipeline beside a plain version of its stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import queries
from panelforge.llm.common import numbered, written
from tests.compare import duck, mismatch
from tests.llm.helpers import BYTE_BPE, documents, library_ids, prose
from tests.llm.test_copies import plain_groups
from tests.llm.test_texts import plain_leaks
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    problem = mismatch(queries.QUERIES[name](spark, SF), queries.SQL[name], duck(SF))
    assert problem is None, problem


@pytest.mark.parametrize("name, key, columns", [
    ("op1_token_counts", "doc_id", {"n_bytes", "n_tokens", "over_limit"}),
    ("op2_language_id", "doc_id", {"held_out", "lang_pred", "score"}),
    ("op4_sharding", "doc_id", {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    ("op5_license_scan", "doc_id", {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}),
    ("op9_token_files", "doc_id", {"start", "n_tokens", "ids_crc32"}),
])
def test_query_gives_a_row_for_each_document(spark, name, key, columns):
    got = queries.QUERIES[name](spark, SF)
    assert columns <= set(got.columns)
    assert sorted(r[key] for r in got.select(key).collect()) == list(range(spark.read.parquet(f"{SF}/documents.parquet").count()))


def test_query_packs_every_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: [*x, 1] for r, x in zip(docs, library_ids(BYTE_BPE, [r["text"] for r in docs]))}
    assert check_pieces(queries.QUERIES["op10_packing"](spark, SF).collect(), want, 2048) < 0.03


def test_pipeline_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert corpus_pipeline.keep_languages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count() == len(texts)
    last = {hashlib.sha256(t.encode()).digest(): i for i, t in sorted(texts.items())}
    left = sorted(last.values())
    groups = plain_groups([texts[i] for i in left], 5, 80)[1]
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    clean = {i: not plain_leaks(texts[i], items) for i in left}
    members = {}
    for i, g in zip(left, groups):
        members.setdefault(g, set()).add(i)
    # One of each group stays, and goes only if it repeats a benchmark item.
    for own in members.values():
        assert len(got & own) <= 1 and (got & own or not all(clean[i] for i in own))
    assert all(clean[i] for i in got) and got <= set(left)


def stage_input(spark):
    near = prose(3, 60, 900)
    rows = [
        (1, "plain words of a text " + prose(1, 40), "en", "s", 3, "x"),
        (1, "plain words of a text " + prose(1, 40), "en", "s", 3, "x"),
        (None, near, None, None, None, None),
        (None, near + " more", "en", "s", 3, "x"),
        (4, None, "en", "s", 3, "x"),
        (5, "", "en", "s", 3, "x"),
        (6, "123 !!", None, "s", 3, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_repeats_and_empty_tables(spark, stage):
    docs = written(stage_input(spark), "stage-input")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, SF)
    texts = sorted((r["text"] or "")[:20] for r in out.collect()) if stage < 4 else []
    assert out.columns == docs.columns or stage == 4
    assert len(texts) == {0: 4, 1: 5, 2: 5, 3: 7, 4: 0}[stage], (name, texts)
    empty = run(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_documents_with_one_hash_are_told_apart(spark):
    """Different documents get different keys and repeated rows one, also where the first hash is the same for all of them."""
    docs = written(stage_input(spark), "stage-input")
    for first in (None, F.lit(7), F.length("text").cast("long")):
        rows = corpus_pipeline.with_key(docs, "_document", first).collect()
        keys = {}
        for r in rows:
            keys.setdefault((r["doc_id"], r["text"]), set()).add(r["_document"])
        assert len(rows) == docs.count() and all(len(own) == 1 for own in keys.values())
        assert len(set.union(*keys.values())) == len(keys)
        assert set(rows[0].asDict()) == {*docs.columns, "_document"}


def test_numbers_have_no_gaps_in_a_large_group(spark):
    df = written(spark.range(30_000).select(F.when(F.col("id") < 25_000, 1).otherwise(2).alias("g"), "id"), "numbers")
    got = numbered(df, ["g"], ["id"], "slot").groupBy("g").agg(F.countDistinct("slot"), F.max("slot"), F.min("slot")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 25_000, 24_999, 0), (2, 5_000, 4_999, 0)]
