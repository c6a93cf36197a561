"""Exact copies, shards, archives and near copies against plain versions."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import signature_join, warc
from panelforge.llm.common import shared_folder
from panelforge.llm.components import components
from panelforge.llm.exact_dedup import exact_dedup
from panelforge.llm.sharding import shard_records
from panelforge.llm.shingles import shingle_sets
from panelforge.llm.signature_join import Tree, links, signature, similar_groups, walk
from tests.llm.helpers import ODD_TEXTS, documents, prose


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize("hot", [0, 300])
def test_exact_dedup(spark, hot):
    """With 300 hot copies the digest is settled by broadcast, without it by the shuffle."""
    texts = ODD_TEXTS + ["hot copy"] * hot + [f"t{i % 40}" for i in range(100)]
    got = exact_dedup(documents(spark, texts), support=0.2).collect()
    groups = plain_copies(enumerate(texts))
    assert len(got) == len(texts)
    for r in got:
        own = groups[r["text"] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert {"slot", "Score"} <= set(got[0].asDict()) and "KEEP_ID" not in got[0].asDict()


@pytest.mark.parametrize("support", [0.3, 0.9])
def test_exact_dedup_keeps_one_of_repeated_rows(spark, support):
    ids = [9] * 60 + [None] * 5 + [3] * 5 + [None, None]
    texts = ["hot"] * 70 + ["no id", "no id"]
    got = exact_dedup(documents(spark, texts, ids), support=support).collect()
    assert sum(r["kept"] for r in got if r["text"] == "hot") == 1 and {r["keep_id"] for r in got if r["text"] == "hot"} == {9}
    assert all(r["doc_id"] == 9 for r in got if r["kept"] and r["text"] == "hot")
    assert [r["kept"] for r in got if r["text"] == "no id"].count(True) == 1 and {r["keep_id"] for r in got if r["text"] == "no id"} == {None}
    assert exact_dedup(documents(spark, [])).count() == 0


def test_shards(spark):
    texts = (ODD_TEXTS * 150)[:3000]
    got = shard_records(documents(spark, texts), [1.0] * 7 + [3.0], [1.0] * 7 + [3.0, 1.0]).collect()
    by = {}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 8)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(got) == 3000
    assert 780 < len(by[7]) < 1020 and all(220 < len(by[i]) < 390 for i in range(7))  # weights 3 and 1 of 10
    moved = sum(r["grown_shard"] == 8 for r in got)
    assert 200 < moved < 350


def test_shards_of_repeated_missing_and_no_ids(spark):
    got = shard_records(documents(spark, ["a", "b", None, "c"], [4, 4, None, None]), [1.0] * 3).collect()
    assert len({r["shard"] for r in got if r["doc_id"] == 4}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert all(r["grown_shard"] is None for r in got) and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert shard_records(documents(spark, []), [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        shard_records(documents(spark, []), [1.0, 0.0])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, kept string, payload_digest string")


def test_archives(spark):
    big, rows = "é" * 600, []
    for i, h in enumerate([big, "small", None, "", big, "small", big + "\r\n\r\nx", "hot" * 500, *["hot" * 500] * 40]):
        rows.append((i, None if i == 3 else f"http://h/{i}\r\nX: y", h))
    folder = shared_folder(spark, "test-warc")
    index = warc.write_archives(pages(spark, rows), folder)
    assert index.count() == len(rows)
    got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    for i, url, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")] if len(data) >= 1000 else [i]
        revisit = i != max(same)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", max(same)) if revisit else ("response", None))
        assert got[i]["payload"] == (None if revisit else h or "") and got[i]["url"] == (None if url is None else f"http://h/{i} X: y")
    some = warc.read_records(index.where("page_id % 7 = 1"), folder).collect()
    assert {r["page_id"] for r in some} == {i for i in range(len(rows)) if i % 7 == 1}
    first = index.orderBy("file", "offset").first()
    raw = gzip.decompress(bytes(spark.read.format("binaryFile").load(f"{folder}/{first['file']}").first()["content"])[: first["length"]])
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")


def test_archives_of_repeated_and_missing_ids(spark):
    long = "z" * 2000
    got = warc.archive(pages(spark, [(5, "u", long), (5, "u", long), (None, None, long), (None, "v", "q")])).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("5", "response", None), ("5", "revisit", 5), ("None", "response", None), ("None", "revisit", 5)]
    assert warc.archive(pages(spark, [])).count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, False).replace(b"abc", b"abd"))


def plain_groups(texts, k, percent):
    """Smallest place reachable by links, from word shingles as tuples."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        for s in "\t\n\x0b\x0c\r":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def families(seed, n=40, members=5):
    rnd = random.Random(seed)
    out = list(ODD_TEXTS)
    for f in range(n):
        base = prose(seed * 1000 + f, rnd.randint(3, 120), 60).split()
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(5)}"
            out.append(rnd.choice([" ", "\n", "  "]).join(w))
    return out


@pytest.mark.parametrize("k, percent, tile, firsts", [(4, 85, 512, 64), (5, 80, 512, 64), (2, 60, 4, 1), (1, 50, 3, 64)])
def test_near_copies(spark, monkeypatch, k, percent, tile, firsts):
    monkeypatch.setattr(signature_join, "TILE", tile)
    monkeypatch.setattr(signature_join, "FIRSTS", firsts)
    texts = families(k)
    sizes, groups = plain_groups(texts, k, percent)
    got = {r["doc_id"]: r for r in similar_groups(documents(spark, texts), k, percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == groups


def test_near_copies_of_repeated_and_missing_ids(spark):
    a, b = prose(1, 80, 10_000), prose(2, 80, 10_000)
    near = " ".join([*a.split()[:-1], "z"])
    got = similar_groups(documents(spark, [a, near, near, b, b, None], [4, None, 2, 2, 9, 1]), 5, 80).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("1", 1), ("2", 2), ("2", 2), ("4", 2), ("9", 2), ("None", 2)]
    assert similar_groups(documents(spark, []), 5, 80).count() == 0
    alone = similar_groups(documents(spark, ["a b c d e f", "a b c d e f"], [None, None]), 5, 80).collect()
    assert [r["component_id"] for r in alone] == [None, None]
    with pytest.raises(ValueError):
        similar_groups(documents(spark, []), 5, 40)


def test_tree_walk_loses_no_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 2**63, int(rng.integers(10, 16)), dtype=np.uint64)
        for _ in range(6):
            s = np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 2**63, len(base), dtype=np.uint64), base))
            sets.append(s)
    bits = [signature(s) for s in sets]
    width = min(map(len, bits))
    folded = np.stack([np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bits]).view(np.uint64)
    sizes = np.array([len(s) for s in sets])
    whole = Tree(sizes, folded)
    a, b = (whole.order[x] for x in walk(whole, whole, 80, True))
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if links(sets[i], sets[j], 80)}
    assert want <= found and len(found) < len(sets) ** 2 / 8 and len(a) == len(found)
    half = len(sets) // 2
    left, right = Tree(sizes[:half], folded[:half]), Tree(sizes[half:], folded[half:])
    a, b = walk(left, right, 80, False)
    a, b = left.order[a], right.order[b]
    across = {(i, j + half) for i, j in zip(a.tolist(), b.tolist())}
    assert {(i, j) for i, j in want if i < half <= j} <= across


def test_shingles_ignore_case_and_spaces():
    a, b = shingle_sets(["One two THREE four five", "one\ttwo  three\nfour five "], 4)
    assert (a == b).all() and len(a) == 2
    assert [len(s) for s in shingle_sets([None, "", "\n", "one", "É é"], 4)] == [0, 0, 0, 1, 1]


def test_components(spark):
    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200)]
    rnd.shuffle(chain)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
