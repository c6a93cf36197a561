"""One query for each operator, over its whole table, with the parameters of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm.common import table
from panelforge.llm.decontaminate import find_leaks
from panelforge.llm.exact_dedup import exact_dedup
from panelforge.llm.importance import resample
from panelforge.llm.language_id import held_out, identify, train
from panelforge.llm.license_scan import license_scan
from panelforge.llm.merkle import manifest
from panelforge.llm.packing import pack
from panelforge.llm.registry import QUERIES, SQL, query
from panelforge.llm.sharding import shard_records
from panelforge.llm.signature_join import similar_groups
from panelforge.llm.token_counts import token_counts
from panelforge.llm.token_store import token_store
from panelforge.llm.url_filter import HOST_RULES, PATTERNS, filter_urls
from panelforge.llm.warc import archive

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), limit=2048)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query(
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


#: Words of a text in SQL: ASCII letters lower-cased, everything but other ASCII characters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: All runs of k words of a list w, each once.
_RUNS = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' ')))"


@query(
    f"""
    WITH i AS (SELECT item_id, v, CASE WHEN len(v) < 10 THEN len(v) ELSE (len(v) + 1) // 2 END AS cut FROM (SELECT item_id, {_WORDS} AS v FROM benchmark)),
    parts AS (SELECT item_id, part, w, least(5, len(w)) AS k FROM (SELECT item_id, 'q' AS part, v[1:cut] AS w FROM i UNION ALL SELECT item_id, 'a', v[cut + 1:] FROM i) WHERE len(w) > 0),
    s AS (SELECT item_id, part, k, unnest({_RUNS}) AS s FROM parts),
    n AS (SELECT item_id, part, count(*) AS n FROM s GROUP BY ALL),
    d AS (SELECT doc_id, k, unnest({_RUNS}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) CROSS JOIN (SELECT DISTINCT k FROM s) WHERE len(w) >= k),
    o AS (SELECT doc_id, item_id, part, count(*) AS found FROM d JOIN s USING (k, s) GROUP BY ALL),
    r AS (
        SELECT doc_id, item_id, max(found / n) FILTER (part = 'q') AS q, coalesce(max(found / n) FILTER (part = 'a'), CASE WHEN any_value(cut = len(v)) THEN 1 ELSE 0 END) AS a
        FROM o JOIN n USING (item_id, part) JOIN i USING (item_id) GROUP BY ALL
    )
    SELECT doc_id, item_id, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap FROM r WHERE q >= 0.8 AND a >= 0.8
    """
)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    overlaps = [F.round(c, 6).alias(c) for c in ("question_overlap", "answer_overlap")]
    return found.select("doc_id", "item_id", *overlaps)


_SHINGLES4 = (
    "list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')] "
    "ELSE list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' ')) END)"
)


@query(
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
    ),
    d AS MATERIALIZED (SELECT doc_id, {_SHINGLES4} AS s FROM w),
    s AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d),
    links AS MATERIALIZED (
        SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON d.doc_id = reach.a GROUP BY d.doc_id, d.s
    """
)
def op7_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
    FROM g
    """
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0)


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=2048, end_id=1)


#: ASCII letters lower-cased in SQL.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A separator of URL patterns in SQL: neither a digit nor a lower-case letter nor outside ASCII; or an end.
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


@query(
    rf"""
    WITH s AS (SELECT page_id, {_LOWER.format("url")} AS low, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM s),
    p AS (SELECT page_id, low, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    rules(rule_host, rule_path, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    patterns(text, act, expr) AS (
        SELECT '^' || w || '^', 'block', '(^|{_SEPARATOR})' || w || '($|{_SEPARATOR})' FROM unnest(['casino', 'pills', 'porn', 'spam', 'viagra', 'xxx']) AS t(w)
        UNION ALL SELECT w, 'block', replace(w, '.', '\.') FROM unnest(['/ads/', '/adserver/', '/cgi-bin/', '/wp-login.php']) AS t(w)
        UNION ALL VALUES ('||doubleclick.*^', 'block', '^[^/?#]*?://([^/?#]*\.)?doubleclick\.'), ('||ads.', 'block', '^[^/?#]*?://([^/?#]*\.)?ads\.'),
            ('^sessionid=*&', 'block', '(^|{_SEPARATOR})sessionid=.*&'), ('/robots.txt|', 'allow', '/robots\.txt$'), ('||gov^', 'allow', '^[^/?#]*?://([^/?#]*\.)?gov($|{_SEPARATOR})')
    ),
    r AS (
        SELECT page_id, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, act := act)) AS best
        FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
    ),
    m AS (SELECT page_id, min(text) FILTER (act = 'allow') AS a, min(text) FILTER (act = 'block') AS b FROM p JOIN patterns ON regexp_matches(low, expr, 's') GROUP BY page_id)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
        coalesce(best.act, CASE WHEN b IS NOT NULL AND a IS NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN best IS NULL THEN coalesce(a, b) END AS pattern
    FROM p LEFT JOIN r USING (page_id) LEFT JOIN m USING (page_id)
    """
)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"), [*HOST_RULES, *PATTERNS])
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern")


#: The unsigned CRC-32 of a string in SQL, over a table of remainders that is computed first.
_CRC_TABLE = (
    "crc_table AS MATERIALIZED (SELECT list(list_reduce([1, 2, 3, 4, 5, 6, 7, 8], "
    "lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS remainders FROM range(256) AS r(i))"
)
_CRC = (
    "xor(list_reduce(list_transform(range(strlen({0})), lambda k: CAST('0x' || substr(hex({0}), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),"
    " lambda a, x: xor(a >> 8, remainders[xor(a & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
)


@query(
    rf"""
    WITH {_CRC_TABLE},
    w AS (SELECT 'd' AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 't', item_id, {_WORDS} FROM benchmark),
    f AS (
        SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
        FROM w
    ),
    b AS MATERIALIZED (SELECT feature, {_CRC.format("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f) CROSS JOIN crc_table),
    c AS MATERIALIZED (SELECT side, id, bucket, count(*) AS n FROM f JOIN b USING (feature) GROUP BY ALL),
    sums AS (SELECT sum(n) FILTER (side = 'd')::DOUBLE AS big_s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS big_t FROM c),
    sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM c GROUP BY bucket),
    gain AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS gain FROM sides, sums),
    weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
    scored AS (
        SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
            CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
        FROM w LEFT JOIN weights USING (id) WHERE side = 'd'
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
    """
)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


@query(
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    ids AS MATERIALIZED (SELECT doc_id, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS bad FROM documents CROSS JOIN crc_table),
    d AS MATERIALIZED (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN bad THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claimed FROM documents JOIN ids USING (doc_id)),
    leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
    nodes AS (
        SELECT lang, 0 AS level, pos AS idx, leaf AS h, n FROM leaves
        UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2
    ),
    tops AS MATERIALIZED (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    uppers AS (
        SELECT 0 AS level, pos AS idx, subroot AS h, n FROM tops
        UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM uppers WHERE n > 1 GROUP BY level, idx // 2
    ),
    root AS (SELECT h AS root, level AS height FROM uppers WHERE n = 1),
    levels AS (SELECT CAST(level AS INT) AS level FROM range(64) AS r(level)),
    steps AS (
        SELECT doc_id, s.level AS k, CASE WHEN o.h IS NULL THEN 'S' WHEN (l.pos >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END AS side, coalesce(o.h, '') AS h
        FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN levels s ON s.level < t.height
        LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = s.level AND o.idx = xor(l.pos >> s.level, 1)
        UNION ALL
        SELECT doc_id, 64 + s.level, CASE WHEN o.h IS NULL THEN 'S' WHEN (t.pos >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END, coalesce(o.h, '')
        FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang CROSS JOIN root JOIN levels s ON s.level < root.height
        LEFT JOIN uppers o ON o.level = s.level AND o.idx = xor(t.pos >> s.level, 1)
    ),
    proofs AS (SELECT doc_id, list(side || h ORDER BY k) AS steps, sha256(string_agg(h, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY doc_id),
    folds AS (
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
            list_reduce(coalesce(steps, []), lambda a, x: CASE x[1] WHEN 'L' THEN sha256(x[2:] || a) WHEN 'R' THEN sha256(a || x[2:]) ELSE sha256(a) END, claimed) AS folded_root
        FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang CROSS JOIN root LEFT JOIN proofs USING (doc_id)
    )
    SELECT *, folded_root = root AS verified FROM folds
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    claimed = F.when(bad, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": claimed})
