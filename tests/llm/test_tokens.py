"""Pre-tokens, token counts, token files and packing against the tokenizers library."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import packing, simple8b
from panelforge.llm.common import shared_folder
from panelforge.llm.files import at
from panelforge.llm.packing import best_filling, pack, places, plan
from panelforge.llm.pieces import Encoder
from panelforge.llm.token_counts import packed, token_counts, unpacked
from panelforge.llm.token_store import read_segment, token_store, write_token_files
from tests.llm.helpers import BYTE_BPE, ODD_TEXTS, WORD_BPE, documents, library_ids


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_ids_equal_the_library(path):
    rnd = random.Random(5)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rnd.choice("ab's 'tl 1²\n\té! İΣ漢 re") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    enc = Encoder(path)
    for _ in range(2):  # the second time from the table of known pre-tokens
        ids, counts = enc.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == library_ids(path, texts)


def test_a_full_store_starts_anew(monkeypatch):
    monkeypatch.setattr(Encoder, "STORE", 10)
    enc = Encoder(BYTE_BPE)
    texts = [f"some words {i} and more {i * 7}" for i in range(40)]
    for k in range(0, 40, 5):
        ids, _ = enc.encode(texts[k : k + 5])
        assert ids.tolist() == [i for x in library_ids(BYTE_BPE, texts[k : k + 5]) for i in x]


def test_very_long_texts_are_cut_safely():
    text = "some words, it's 12 of them  and more " * 60_000
    ids, counts = Encoder(BYTE_BPE).encode(["a b", text, "c"])
    want = library_ids(BYTE_BPE, ["a b", text, "c"])
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_integer_planes_round_trip():
    for values in ([], [0], [1, 2**32 - 1, 7] * 100):
        assert unpacked(packed(np.array(values, np.uint32))).tolist() == values


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 20])
def test_token_counts(spark, block_bytes):
    got = {r["doc_id"]: r for r in token_counts(documents(spark, ODD_TEXTS), WORD_BPE, limit=100, block_bytes=block_bytes).collect()}
    want = [len(i) for i in library_ids(WORD_BPE, ODD_TEXTS)]
    assert [got[i]["n_tokens"] for i in range(len(want))] == want
    assert [got[i]["n_bytes"] for i in range(len(want))] == [len((t or "").encode()) for t in ODD_TEXTS]
    assert all(got[i]["over_limit"] == (want[i] > 100) for i in got)


def test_token_counts_of_repeated_and_missing_ids(spark):
    got = token_counts(documents(spark, ["a b", "a b", "c"], [7, 7, None]), WORD_BPE).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("7", 2), ("7", 2), ("None", 1)]
    assert token_counts(documents(spark, []), WORD_BPE).count() == 0


@pytest.mark.parametrize("kind", ["small", "runs", "wide", "one", "empty"])
@pytest.mark.parametrize("ranks", [4, 1 << 16])
def test_simple8b_round_trip(kind, ranks):
    rng = np.random.default_rng(3)
    ids = {
        "small": rng.integers(0, 5, 5000),
        "runs": np.repeat(rng.integers(0, 3, 60), 400),
        "wide": rng.integers(0, 2**32 - 1, 3001),
        "one": np.array([4_000_000_000]),
        "empty": np.zeros(0),
    }[kind].astype(np.uint32)
    table, offsets, words = simple8b.encode(ids, block=256, ranks=ranks)
    assert (simple8b.decode(table, offsets, words, len(ids), block=256) == ids).all()
    if kind == "runs" and ranks > 4:
        assert len(words) < len(ids) / 45  # runs of the commonest id take 240 to a word, others 60 or 30


def test_simple8b_blocks_decode_alone():
    ids = np.random.default_rng(1).zipf(1.3, 2000).astype(np.uint32)
    table, offsets, words = simple8b.encode(ids, block=128)
    k = 5
    own = words[offsets[k] : offsets[k + 1]]
    assert (simple8b.decode(table, np.array([0, len(own)]), own, 128, block=128) == ids[k * 128 : (k + 1) * 128]).all()


def test_token_files(spark):
    texts = ODD_TEXTS * 3
    ids = [5 * i - 40 for i in range(len(texts))]
    got = sorted(token_store(documents(spark, texts, ids), BYTE_BPE, end_id=0).collect())
    want, start = [], 0
    for i, x in zip(ids, library_ids(BYTE_BPE, texts)):
        x = [*x, 0]
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert [tuple(r) for r in got] == want


def test_token_files_of_repeated_and_missing_ids(spark):
    texts = ["a b c", "d", "a b c", "e f", ""]
    got = token_store(documents(spark, texts, [3, None, 3, 3, None]), BYTE_BPE).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(x) + 1 for x in library_ids(BYTE_BPE, texts))
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in got)
    assert [e[0] for e in ends] == [0, *[e[1] for e in ends[:-1]]] and [e[2] for e in ends] == [None, None, 3, 3, 3]
    assert token_store(documents(spark, []), BYTE_BPE).count() == 0


def test_segments_stand_alone(spark):
    folder = shared_folder(spark, "test-tokens")
    index = write_token_files(documents(spark, ["one two", "three"], [2, 1]), BYTE_BPE, folder, end_id=None).collect()
    system, root = at(folder)
    got = {}
    for r in index:
        with system.open_input_file(f"{root}/{r['file']}") as f:
            docs, lens, ids = read_segment(f.read_at(r["length"], r["offset"]))
        for d, x in zip(docs.to_pylist(), np.split(ids, np.cumsum(lens)[:-1])):
            got[d] = x.tolist()
    assert [got[2], got[1]] == library_ids(BYTE_BPE, ["one two", "three"])
    with pytest.raises(ValueError):
        read_segment(b"X" * 64)


def test_best_filling_is_the_best():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 60)
        sums = {sum(k * n for k, n in zip(counts, pick)) for pick in itertools.product(*[range(n + 1) for n in counts.values()])}
        best, used = best_filling(counts, room)
        assert best == max(s for s in sums if s <= room) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    rnd = random.Random(4)
    counts = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(30)}
    fillings, over = plan(counts, 64, exact=True)
    assert all(sum(k * n for k, n in used.items()) == 64 for used, _ in fillings)
    rows, free = places(fillings, 0)
    for k, n in counts.items():
        ends = sorted((lo, hi) for length, lo, hi, *_ in rows if length == k)
        assert sum(hi - lo for lo, hi in ends) + over.get(k, 0) == n
    assert free == sum(t for _, t in fillings)


def check_pieces(got, want: dict, capacity: int):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        own = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"] > 0
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["length"] for r in rows)][:-1]
        assert sum(r["length"] for r in rows) == len(want[d])
    assert set(by_doc) == set(want)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [0, *itertools.accumulate(r["length"] for r in rows)][:-1]
        assert sum(r["length"] for r in rows) <= capacity
    return sum(capacity - sum(r["length"] for r in rows) for rows in by_seq.values()) / max(1, sum(r["length"] for r in got))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(spark, capacity):
    texts = ODD_TEXTS + [" ".join(["alpha beta", "gamma"][i % 2] for _ in range(i % 97)) for i in range(300)]
    want = {i: [*x, 1] for i, x in enumerate(library_ids(BYTE_BPE, texts))}
    waste = check_pieces(pack(documents(spark, texts), BYTE_BPE, capacity=capacity).collect(), want, capacity)
    assert waste < (0.02 if capacity == 64 else 0.2)  # 2048: all the rest fits into a few sequences


def test_pack_cuts_lengths_that_nothing_completes(spark):
    """All remainders are 1500 ids: blocks of them fill sequences nearly whole."""
    texts = ["hello " * 1499] * 120
    lens = {len(x) + 1 for x in library_ids(BYTE_BPE, texts[:1])}
    assert 1024 < lens.pop() < 2048
    want = {i: [*x, 1] for i, x in enumerate(library_ids(BYTE_BPE, texts))}
    assert check_pieces(pack(documents(spark, texts), BYTE_BPE).collect(), want, 2048) < 0.05


def test_pack_of_repeated_and_missing_ids(spark):
    got = pack(documents(spark, ["a", "a", "b c", None], [1, 1, None, 2]), BYTE_BPE).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]
    assert sum(r["length"] for r in got) == 2 + 2 + 3 + 1
    assert pack(documents(spark, []), BYTE_BPE).count() == 0
