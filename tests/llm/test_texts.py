"""Language identification, licence scan and decontamination against plain versions and held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, language_id
from panelforge.llm.decontaminate import all_words, build_index, drop_leaks, find_leaks, halves, leaks_of, retrieve, shingles
from panelforge.llm.language_id import has_letter, held_out, identify, ngram_counts, train
from panelforge.llm.license_scan import Scanner, SuffixAutomaton, license_scan
from panelforge.llm.license_texts import NOTICES, PHRASES
from tests.llm.helpers import ODD_TEXTS, documents, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return train(docs.where(~held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(held_out(F.col("doc_id")))
    right = identify(docs, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert right[0] > 0.99 and right[1] < 0.01


def test_identify_odd_texts(spark, model):
    got = {r["doc_id"]: r for r in identify(documents(spark, [*ODD_TEXTS, "Это совсем другой язык, и букв его модель никогда не видела"]), model).collect()}
    assert len(got) == len(ODD_TEXTS) + 1
    for i, t in enumerate(ODD_TEXTS):
        assert (got[i]["lang_pred"] == "und") == (not has_letter(t)) and 0 <= got[i]["score"] <= 1
        assert has_letter(t) or got[i]["rejected"]
    assert got[len(ODD_TEXTS)]["rejected"] and got[0]["KEEP_ID"] == "x" and "Score" not in got[0].asDict()


def test_identify_without_training(spark):
    empty = train(documents(spark, []).withColumn("lang", F.lit(None).cast("string")))
    got = identify(documents(spark, ["some text"]), empty).first()
    assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)
    assert identify(documents(spark, []), empty).count() == 0


def test_training_takes_a_bounded_sample_in_hash_order(spark):
    docs = spark.createDataFrame([(i, "ab cd " * (i % 5 + 1), "x" if i % 2 else "y") for i in range(50)], "doc_id long, text string, lang string")
    a, b = train(docs, texts=5), train(docs.repartition(7), texts=5)
    assert a.languages == b.languages and np.allclose(a.centroids, b.centroids) and np.allclose(a.idf, b.idf)


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


def test_training_draws_from_the_rows_that_have_letters(spark):
    """Many rows without letters do not starve the sample."""
    rows = [("en", "some english words in a row " * 3 if i % 100 == 0 else "123 456") for i in range(20_000)]
    drawn = []
    real = language_id._fit_group
    try:
        language_id._fit_group = lambda idf: drawn.append(idf) or real(idf)
        model = train(labelled(spark, rows))
    finally:
        language_id._fit_group = real
    # All 200 usable texts are alike: each n-gram that one has, all have.
    assert model.languages and np.isclose(drawn[0].min(), 1.0) and np.isclose(drawn[0].max(), np.log(201) + 1)


@pytest.mark.parametrize("wrong", [0, 1, 5])
def test_a_few_mislabelled_texts_do_not_end_rejection(spark, wrong):
    rnd = random.Random(2)
    english = "the of and to in that it is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    russian = "это совсем другой язык и букв его модель никогда не видела прежде чем кто то дал ей один такой текст с чужой меткой дом река город слово время".split()
    say = lambda words, n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [("en", say(english, 60)) for _ in range(300)] + [("en", say(russian, 60)) for _ in range(wrong)]
    model = train(labelled(spark, rows))
    got = identify(documents(spark, [say(russian, 60) for _ in range(50)] + [say(english, 60) for _ in range(50)]), model).collect()
    assert [r["rejected"] for r in sorted(got, key=lambda r: r["doc_id"])] == [True] * 50 + [False] * 50


def test_predictions_equal_plain_cosines(spark, model):
    """Counts of letter pairs and triples by dictionaries, weights and cosines written out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    mask = (1 << 64) - 1

    def places(text):
        seq = [0]
        for c in " " + (text or "") + " ":
            p = ord(c.lower()[0]) if c.isalpha() else 0
            if p or seq[-1]:
                seq.append(p)
        seq += [0] * (seq[-1] != 0)
        pair = lambda a, b: (((a * 0x9E3779B97F4A7C15) & mask) ^ (((b + 1) * 0xC2B2AE3D27D4EB4F) & mask)) * 0xD6E8FEB86659FD93 & mask
        for i in range(len(seq) - 1):
            yield pair(seq[i], seq[i + 1]) >> 52
            if i + 2 < len(seq) and seq[i + 1]:
                yield ((pair(seq[i], seq[i + 1]) ^ ((seq[i + 2] + 7) * 0xA0761D6478BD642F & mask)) * 0xE7037ED1A0B428DB & mask) >> 52

    got = {r["doc_id"]: r for r in identify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), model).collect()}
    for r in docs:
        if not has_letter(r["text"]):
            continue
        v = {}
        for p in places(r["text"]):
            v[p] = v.get(p, 0.0) + model.idf[p]
        norm = sum(x * x for x in v.values()) ** 0.5
        cos = [sum(x * c[p] for p, x in v.items()) / norm for c in model.centroids]
        best = max(cos)
        assert abs(got[r["doc_id"]]["score"] - best) < 1e-9
        assert got[r["doc_id"]]["lang_pred"] in {model.languages[i] for i, c in enumerate(cos) if c > best - 1e-9}


def test_ngrams_of_a_long_text_are_those_of_its_parts(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abc xyz") for _ in range(4000))
    whole = ngram_counts([text, "ab"])
    monkeypatch.setattr(language_id, "PART", 300)
    assert (ngram_counts([text, "ab"]) == whole).all()


def plain_base(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rnd = random.Random(3)
    pool = [w for p in PHRASES for w in p.split()] + ["x", "license2"]
    texts = ODD_TEXTS + [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += [f"{prose(i, 30)}. {notice}! {prose(i + 1, 30)}" for i, (_, notice) in enumerate(NOTICES)]
    texts += ["CC-BY-NC under the\nMIT license; Apache License, Version 2.0; cc by nc by nc cc by nc"]
    got = {r["doc_id"]: r for r in license_scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    at = len(ODD_TEXTS) + 400
    for k, (label, notice) in enumerate(NOTICES):
        assert label in got[at + k]["labels"].split(",") and got[at + k]["score"] >= 0.8
        assert got[at + k]["spans"][0]["first"] >= 25
    assert not any(got[i]["labels"] for i, t in enumerate(ODD_TEXTS))


def test_license_notice_with_changes_is_found():
    scan = Scanner(PHRASES, NOTICES).scan
    mit = dict(NOTICES)["mit"].split()
    changed = mit[:12] + ["really"] + mit[12:30] + mit[31:]
    *_, labels, score, spans = scan(" ".join(changed))
    assert labels == "mit" and 0.9 < score <= 1 and len(spans) == 1
    assert scan(" ".join(mit[:15]))[5] == ""
    repeated = scan((" ".join(mit) + " . ") * 50)
    assert len(repeated[7]) == 50 and repeated[5] == "mit"
    by_nc = "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"
    assert scan(by_nc)[5] == "cc-by-nc"


def test_automaton_knows_all_stretches():
    rnd = random.Random(9)
    texts = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(1, 12))] for _ in range(6)]
    auto = SuffixAutomaton(texts)
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                ends = {(n, k + j - i - 1) for n, u in enumerate(texts) for k in range(len(u)) if u[k : k + j - i] == t[i:j]}
                assert set(auto.ends[auto.find(t[i:j])]) == ends


def benchmark(n=60):
    return [(i, prose(1000 + i, 15 + i % 50, 3000)) for i in range(n)]


def plain_leaks(text, items):
    words, out = all_words(text), set()
    own = {tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1)}
    for i, t in items:
        parts = [shingles(all_words(h)) for h in halves(t)]
        if any(parts) and all(len(p & own) >= 0.8 * len(p) for p in parts):
            out.add(i)
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 2000])
def test_leaks(spark, index_bytes):
    rnd = random.Random(7)
    items = benchmark() + [(900, None), (901, ""), (902, "two words"), (903, benchmark()[3][1])]
    texts = list(ODD_TEXTS)
    for i, t in benchmark():
        w = t.split()
        texts.append(f"{prose(i, 200, 3000)} {t.upper()}, {prose(i + 1, 100, 3000)}")
        texts.append(" ".join(w[: len(w) // 2]) + " " + prose(i, 50, 3000))
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append("with two words inside")
    docs = documents(spark, texts)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in find_leaks(docs, tests, index_bytes=index_bytes).collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    want = {i: f for i, t in enumerate(texts) if (f := plain_leaks(t, items))}
    assert got == want and len(want) >= 60 and {3, 903} <= set().union(*want.values())
    kept = drop_leaks(docs, tests, index_bytes=index_bytes)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - set(want) and kept.columns == docs.columns
    assert find_leaks(documents(spark, []), tests).count() == 0 and find_leaks(docs, tests.limit(0)).count() == 0


def reached(index, own):
    """Items that a passage with the terms ``own`` scores high enough."""
    own = np.array(sorted(own), np.int64)
    return {i for i in range(len(index.items)) if index.scores(np.full(len(own), i), own).sum() >= index.thresholds[i]}


@pytest.mark.parametrize("common, entries, span", [(64, 1 << 21, 1 << 18), (0, 50, 64), (2, 10, 96), (10**6, 1, 1 << 18)])
def test_retrieval_scores_every_passage_that_reaches_its_threshold(monkeypatch, common, entries, span):
    """Pruning by maxima gives the items that scoring all of them gives."""
    for name, value in (("COMMON", common), ("ENTRIES", entries), ("SPAN", span)):
        monkeypatch.setattr(decontaminate, name, value)
    index = build_index([(i, *halves(t)) for i, t in benchmark()])
    terms = np.array([index.terms.get(w, -1) for w in all_words(" ".join(t for _, t in benchmark()[::7]) + prose(5, 300, 3000))])
    want = set()
    for a in range(0, max(1, len(terms) - decontaminate.PASSAGE // 2), decontaminate.PASSAGE // 2):
        want |= reached(index, {t for t in terms[a : a + decontaminate.PASSAGE].tolist() if t >= 0})
    got = retrieve(index, [terms[:0], terms, terms[:5]])
    assert set(got[1]) == want and len(want) >= 9 and not got[0]


def test_items_of_common_words_are_retrieved_beside_a_rare_word_of_another_item():
    rnd = random.Random(11)
    common = [f"c{k}" for k in range(60)]
    items = [(i, " ".join(rnd.choice(common) if i % 10 == 0 or k % 3 else f"r{rnd.randrange(6000)}" for k in range(30))) for i in range(1000)]
    index = build_index([(i, *halves(t)) for i, t in items])
    texts = [t for i, t in items if i % 10 == 0]
    rare = [next(w for w in items[i + 5][1].split() if w[0] == "r") for i, _ in items if i % 10 == 0]
    docs = [np.array([index.terms[w] for w in all_words(" ".join([*t.split()[:3], r, t]))]) for t, r in zip(texts, rare)]
    assert index.size[[index.terms[c.encode()] for c in common]].min() > decontaminate.COMMON > index.size[[index.terms[r.encode()] for r in rare]].max()
    for k, (doc, got) in enumerate(zip(docs, retrieve(index, docs))):
        want = set().union(*[reached(index, set(doc[a : a + 8].tolist())) for a in range(0, len(doc) - 4, 4)])
        assert set(got) == want and 10 * k in {index.items[i] for i in got}


@pytest.mark.parametrize("words, gap", [(n, g) for n in (10, 20, 30, 40, 60, 120) for g in (0, 150)])
def test_split_and_worn_leaks_are_all_found(words, gap):
    """Question and answer apart, each without the shingles that may be missing, at its heaviest end: recall is 1."""
    items = [(i, prose(i, words, 4000)) for i in range(400)]
    index = build_index([(i, *halves(t)) for i, t in items])
    texts = []
    for i, t in items:
        w = t.split()
        q, a = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
        worn = [["changed"] * int(0.2 * max(1, len(h) - 4) + 1e-9) + h[int(0.2 * max(1, len(h) - 4) + 1e-9) :] for h in (q, a)]
        texts.append(f"{prose(i + 1, 40, 9000)} {' '.join(worn[0])} {prose(i + 2, gap, 9000)} x {' '.join(worn[1])} end")
    want = [plain_leaks(t, [items[i]]) for i, t in enumerate(texts)]
    got = [{h[0] for h in hits} for hits in leaks_of(index, texts)]
    assert all(w <= g for w, g in zip(want, got)) and sum(map(bool, want)) == 400


def test_scattered_shingles_of_an_item_are_found():
    """Every found shingle stands alone, in any order, in other words."""
    rnd = random.Random(3)
    for case in range(60):
        items = [(i, prose(100 * case + i, rnd.randrange(10, 50), 300)) for i in range(20)]
        index = build_index([(i, *halves(t)) for i, t in items])
        runs = []
        for half in halves(items[case % 20][1]):
            own = sorted(shingles(half.split()))
            runs += [" ".join(s) for s in rnd.sample(own, -(-8 * len(own) // 10))]
        rnd.shuffle(runs)
        text = " ".join(f"{r} {prose(rnd.randrange(10**6), rnd.randrange(1, 9), 5000)}" for r in runs)
        assert {h[0] for h in leaks_of(index, [text])[0]} == plain_leaks(text, items) >= {case % 20}


def test_question_and_answer_columns(spark):
    q, a = prose(1, 20, 900), prose(2, 12, 900)
    tests = spark.createDataFrame([(1, q, a), (2, q, None)], "item_id long, q string, a string")
    docs = documents(spark, [f"{q} {a}", q, a], [5, 5, None])
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in find_leaks(docs, tests, question_col="q", answer_col="a").collect())
    assert got == [("5", 1), ("5", 2), ("5", 2)]
