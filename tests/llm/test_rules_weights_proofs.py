"""URL rules, importance resampling and Merkle manifests beside plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import importance as I
from panelforge.llm import merkle as M
from panelforge.llm import url_filter as U
from panelforge.llm.common import written
from tests.llm.helpers import ODD_TEXTS, documents, prose

URLS = [
    None, "", "no scheme", "://", "http://net", "http://net/", "http://NET/x", "http://a.b.net/en/x", "http://Example.NET/en/x?q=http://x.org/fr/", "http://www.example.net/EN/",
    "http://xexample.net/en/", "http://example.net", "http://example.com/de", "http://example.com/de/", "http://m.example.com:80/de/", "ftp://x.org/fr/#y", "http://x.org?/fr/", "http://x.org#/fr/",
    "http://cheap-pills.example.com/en/1", "http://a.com/PORN/", "http://a.com/pornography/", "http://a.com/ads/x", "http://ads.a.com/", "http://bads.a.com/", "http://x.gov/casino/", "http://a.com/robots.txt",
    "http://a.com/robots.txt?casino", "http://doubleclick.com", "http://a.com/?sessionid=7&x=1", "http://a.com/?sessionid=7", "http://ü.net/ß", "x\n://a.net/\n", "://org/fr/", "http://.net/", "a://b.net://c.org/fr/",
]


def plain_pattern(text):
    """The pattern as one expression with every choice left open."""
    text = text.translate(U.ASCII_LOWER)
    front, text = (r"\A[^/?#]*?://(?:[^/?#]*\.)?", text[2:]) if text.startswith("||") else (r"\A", text[1:]) if text.startswith("|") else ("", text)
    back, text = (r"\Z", text[:-1]) if text.endswith("|") else ("", text)
    special = {"*": "(?s:.)*", "^": r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]|\A|\Z)"}
    return front + "".join(special.get(c) or re.escape(c) for c in text) + back


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        path = re.split(r"[?#]", rest[k:], maxsplit=1)[0]
    best = None
    for r in rules:
        if not r.pattern:
            h, slash, p = r.text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                best = max(best or (0, "", ""), (len(r.text), r.text, r.action))
    hits = {"allow": [], "block": []}
    for r in rules:
        if r.pattern and url is not None and re.search(plain_pattern(r.text), url.translate(U.ASCII_LOWER)):
            hits[r.action].append(r.text)
    if best:
        return host, path, best[1], best[2], None
    pattern = min(hits["allow"] or hits["block"], default=None)
    return host, path, None, "block" if hits["block"] and not hits["allow"] else "allow", pattern


def pages(spark, urls):
    rows = [(None if i % 7 == 6 else i, u, "x", "y", 1) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, HOST string, verdict string, row int")


@pytest.mark.parametrize("limit", [None, 200])
def test_url_verdicts_equal_a_walk_over_all_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "RULE_BYTES", limit or U.RULE_BYTES)
    rules = [*U.HOST_RULES, *U.PATTERNS, U.Rule("allow", "net/"), U.Rule("block", "b.net"), U.Rule("block", "*x*", True), U.Rule("allow", "|ftp:", True)]
    assert (len(U.in_blocks(rules)) > 1) == bool(limit)
    rules += [U.Rule("block", t, True) for t in ("a*b*|", "|http*e*n^", "||*.com^|", "*", "^x*^q=*|")[: 5 if limit else 3]]
    urls = URLS * 2
    got = [tuple(r)[1:6] for r in U.filter_urls(pages(spark, urls), rules).collect()]
    want = [plain_verdict(u, rules) for u in urls]
    assert Counter(got) == Counter(want)
    assert U.filter_urls(pages(spark, urls), rules).columns == ["page_id", "host", "path", "rule", "verdict", "pattern", "tried"]


def test_url_rules_are_tried_only_for_their_rarest_token(spark):
    rules = [U.Rule("block", f"site{i}.com/", False) for i in range(500)] + [U.Rule("block", f"/path{i}/*.gif|", True) for i in range(500)]
    urls = [f"http://www.site{i % 700}.com/path{i % 900}/a.gif" for i in range(2_000)]
    got = U.filter_urls(pages(spark, urls), rules)
    assert Counter(tuple(r)[1:6] for r in got.collect()) == Counter(plain_verdict(u, rules) for u in urls)
    assert got.agg(F.max("tried")).first()[0] <= 2


def test_very_long_urls(spark):
    rules = [U.Rule("block", t, True) for t in ("*q*w*", "a*a*q|", "^casino^", "||z.*^z")]
    urls = ["http://" + "a/" * 400_000 + "?casino", "http://" + "a." * 400_000 + "/"]
    assert [r["verdict"] for r in U.filter_urls(pages(spark, urls), rules).orderBy("page_id").collect()] == ["block", "allow"]


def test_urls_of_empty_tables_and_rules(spark):
    assert U.filter_urls(pages(spark, URLS).limit(0), list(U.HOST_RULES)).count() == 0
    assert {r["verdict"] for r in U.filter_urls(pages(spark, URLS), []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        U.filter_urls(pages(spark, URLS), [U.Rule("block", "/x")])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_runs(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent=5, least=20):
    runs = [plain_runs(t) for _, t in rows]
    s, t = Counter(b for _, r in runs for b in r), Counter(b for x in target for b in plain_runs(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000))))
    out, order = [], []
    for k, ((i, _), (n, r)) in enumerate(zip(rows, runs)):
        weight = sum(map(gain, r))
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        out.append([i, len(r), weight, score, None])
        if n >= least:
            order.append((-score, i is None, i or 0, k))
    for rank, (*_, k) in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        out[k][4] = rank
    return out


@pytest.mark.parametrize("bits, at_once", [(11, 200_000), (3, 7)])
def test_resampling_equals_a_plain_version(spark, monkeypatch, bits, at_once):
    monkeypatch.setattr(I, "DIGIT_BITS", bits)
    monkeypatch.setattr(I, "AT_ONCE", at_once)
    monkeypatch.setattr(I, "BLOCK_ROWS", 9)
    texts = [*ODD_TEXTS, *[prose(k, 5 + k % 40, 60) for k in range(150)], "日" * 300 + " " + "z" * 64 + " B " * 30]
    ids = [None if k == 40 else (-5) ** (k % 9) if k % 9 == 0 else k for k in range(len(texts))]
    target = [prose(k, 30, 20) for k in range(6)] + [None]
    docs = documents(spark, texts, ids)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.resample(docs, items, percent=40).collect()
    want = plain_resample(list(zip(ids, texts)), target, 40)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert I.resample(docs.limit(0), items).count() == 0


def test_radix_order_of_extreme_keys_is_stable(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_ROWS", 50)
    rnd = random.Random(4)
    rows = [(rnd.choice([None, -(1 << 63), (1 << 63) - 1, -1, 0, 1, rnd.getrandbits(40)]), rnd.choice([-(1 << 62), 3, 1 << 62]), k) for k in range(600)]
    df = written(spark.createDataFrame(rows, "a long, b long, k long").coalesce(1), "keys")
    got, n = I.radix_ranked(df, [("b", True), ("a", False)])
    order = [r["k"] for r in sorted(got.collect(), key=lambda r: r["pos"])]
    first = {r["k"]: i for i, r in enumerate(df.collect())}
    assert n == 600 and order == [k for a, b, k in sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, first[r[2]]))]


def test_gains_favour_the_target():
    corpus, target = np.array([1000, 10, 0]), np.array([0, 10, 0])
    g = I.gains(corpus, target)
    assert g[1] > 0 > g[0]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: plain_tree(map(leaf, groups[g])) for g in order}
    top = plain_tree(trees[g][-1][0] for g in order)
    out = []
    for gi, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now, siblings = leaf((*r[:3], r[3] + 1, r[4]) if bad else r), []
            for levels, at in ((trees[g], i), (top, gi)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(other)
                    now = H(other, now) if at & 1 else H(now, other)
                    at >>= 1
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, H(*siblings), now, now == root))
    return out


def leaves_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, LEAF string, tree int")


def prove(docs):
    bad = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    return M.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": F.when(bad, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))})


@pytest.mark.parametrize("bits, held", [(10, 200_000), (2, 200_000), (1, 3)])
def test_manifest_equals_a_plain_version(spark, monkeypatch, bits, held):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    monkeypatch.setattr(M, "BROADCAST_ROWS", held)
    rnd = random.Random(7)
    langs = ["en"] * 60 + ["é", "z", "", None, "Z", "de", "fr", "fr", "fr", "it", "it"]
    rows = [(None if k % 50 == 9 else k, rnd.choice(["s", None]), rnd.choice(langs), rnd.choice([None, k]), ODD_TEXTS[k % len(ODD_TEXTS)]) for k in range(170)]
    rows += rows[:7] + [(3, "s", "only", 1, "lone"), (1000, None, None, None, None)]
    key = lambda r: tuple(str(x) for x in r)
    got = prove(leaves_table(spark, rows))
    assert sorted(map(key, got.collect())) == sorted(map(key, plain_manifest(rows)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_manifests(spark, n):
    rows = [(i, "s", "en", 4, "text") for i in range(n)]
    assert sorted(map(str, (tuple(r) for r in prove(leaves_table(spark, rows)).collect()))) == sorted(map(str, plain_manifest(rows)))


@pytest.mark.parametrize("seed", range(20))
def test_multiproofs_are_whole_and_minimal(seed):
    rnd = random.Random(seed)
    n = rnd.randrange(1, 70)
    leaves = [H(str(i)) for i in range(n)]
    levels = plain_tree(leaves)
    known = sorted(rnd.sample(range(n), rnd.randrange(1, n + 1)))
    wanted = M.missing_nodes(known, n)
    fetched = {(level, i): levels[level][i] for level, i in wanted}
    nodes = M.derived_nodes({i: leaves[i] for i in known}, fetched, n)
    for i in known:
        assert M.folded(leaves[i], M.proof_of(nodes, i, n)) == levels[-1][0]
    # Nothing fetched covers a known leaf or another fetched node: none of it could be derived.
    covered = [set(range(i << level, min((i + 1) << level, n))) for level, i in wanted]
    assert sum(map(len, covered)) == len(set().union(*covered)) and not set(known) & set().union(*covered)
    assert len(set(known) | set().union(*covered)) == n
