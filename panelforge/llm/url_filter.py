"""URL verdicts from many pattern rules: each rule is filed under its rarest literal token, and a URL's tokens fetch the few rules to try.

Two kinds of rules:

- host rules (``block net/``, ``allow example.net/en/``): fit the host and all its subdomains where the path starts with the rule's
  path; the longest rule decides.
- patterns, for URLs that no host rule fits: ``*`` any characters, ``^`` a character that is neither letter nor digit (or an end),
  ``|`` at either end the URL's end, ``||`` at the front the start of a host label, anything else literally, ASCII case ignored. Any
  fitting allow pattern beats the block patterns.

A token is a maximal run of digits, letters and non-ASCII characters. A rule may be filed under a token only if the rule says where
the token ends on both sides, as then every URL that fits has the same token. Rules without such a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import ship_package, written

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
PARTS = re.compile(r"(?s)\A.*?://([^/?#]*)([^?#]*)")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A token between two characters of a rule that are neither token characters nor "*".
_BOUNDED = re.compile(r"(?<=[\x00-\x29\x2B-\x2F\x3A-\x60\x7B-\x7F])[^\x00-\x2F\x3A-\x60\x7B-\x7F]+(?=[\x00-\x29\x2B-\x2F\x3A-\x60\x7B-\x7F])")
_SEPARATOR = r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]|\A|\Z)"

#: Text of the rules in one broadcast index; a longer list is applied in several passes.
RULE_BYTES = 8 << 20
#: Compiled expressions that a task keeps.
COMPILED = 20_000


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path (``example.net/en/``) or, with ``pattern``, a pattern."""

    action: str
    text: str
    pattern: bool = False

    def expression(self) -> str:
        """The regular expression: over host and path for a host rule, over the lower-cased URL for a pattern."""
        if not self.pattern:
            host, slash, path = self.text.partition("/")
            return r"\A(?:[^/]*\.)?" + re.escape(host.translate(ASCII_LOWER)) + (re.escape(slash + path) if slash else r"(?=/|\Z)")
        text, front = self.text.translate(ASCII_LOWER), r".*?"
        if text.startswith("|"):
            text, front = (text[2:], r"[^/?#]*?://(?:[^/?#]*?\.)??") if text.startswith("||") else (text[1:], "")
        ends = text.endswith("|")
        parts = ["".join(_SEPARATOR if c == "^" else re.escape(c) for c in p) for p in text.removesuffix("|").split("*")]
        # The leftmost place of each part is the best one, so nothing is tried again and long URLs take linear time.
        parts = [front + parts[0], *[r".*?" + p for p in parts[1:]]]
        return r"(?s)\A" + "".join(f"(?>{p})" for p in parts[: len(parts) - ends]) + (parts[-1] + r"\Z" if ends else "")

    def tokens(self) -> set[str]:
        """Tokens that every fitting URL has."""
        text = self.text.translate(ASCII_LOWER)
        if self.pattern:
            text = text.replace("|", " ").replace("^", " ")
        else:
            text = f" {text}" if "/" in text else f" {text} "
        return set(_BOUNDED.findall(text))


#: Rules of the query op11.
HOST_RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
#: Patterns of the query op11: pages that hold advertisements, logins or spam by their address.
PATTERNS = tuple(
    [Rule("block", p, True) for p in ("^casino^", "^pills^", "^porn^", "^spam^", "^viagra^", "^xxx^", "/ads/", "/adserver/", "/cgi-bin/", "/wp-login.php", "||doubleclick.*^", "||ads.", "^sessionid=*&")]
    + [Rule("allow", p, True) for p in ("/robots.txt|", "||gov^")]
)


def host_path(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower-cased) and path; both empty without ``://``."""
    found = PARTS.match(url) if url else None
    return (found[1].translate(ASCII_LOWER), found[2]) if found else ("", "")


def url_tokens(url: str | None) -> set[str]:
    return set(TOKEN.findall(url.translate(ASCII_LOWER))) if url else set()


def _count_tokens(known: Broadcast):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in it:
            for url in batch.column(0).to_pylist():
                counts.update(url_tokens(url) & known.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

    return run


def token_frequencies(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs have each token of the rules: at most one number for each token of the rule list reaches the driver."""
    known = frozenset().union(*[r.tokens() for r in rules])
    counted = urls.mapInArrow(_count_tokens(urls.sparkSession.sparkContext.broadcast(known)), "token string, n long")
    return dict(map(tuple, counted.groupBy("token").agg(F.sum("n")).collect()))


def indexed(rules: Sequence[Rule], frequency: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token (of equally rare ones the first); under None the rules without one."""
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        token = min(r.tokens(), key=lambda t: (frequency.get(t, 0), t), default=None)
        index.setdefault(token, []).append(r)
    return index


def in_blocks(rules: Sequence[Rule], limit: int | None = None) -> list[list[Rule]]:
    """The rules in blocks of at most ``limit`` bytes of text (a longer rule alone)."""
    limit, blocks, held = limit or RULE_BYTES, [[]], 0
    for r in rules:
        n = len(r.text.encode()) + 64
        if blocks[-1] and held + n > limit:
            blocks.append([])
            held = 0
        blocks[-1].append(r)
        held += n
    return blocks


@lru_cache(maxsize=COMPILED)
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.expression())


def try_rules(url: str | None, index: dict[str | None, list[Rule]]) -> tuple:
    """(host, path, longest fitting host rule or None, its action, first fitting allow pattern, first fitting block pattern, rules tried)."""
    host, path = host_path(url)
    lowered = (url or "").translate(ASCII_LOWER)
    best, hits, tried = None, {"allow": None, "block": None}, 0
    for token in (None, *url_tokens(url)):
        for r in index.get(token, ()):
            tried += 1
            if r.pattern:
                if url is not None and _compiled(r).match(lowered):
                    hits[r.action] = min(hits[r.action] or r.text, r.text)
            elif _compiled(r).match(host + path):
                best = max(best or (0, "", ""), (len(r.text), r.text, r.action))
    _, rule, action = best or (0, None, None)
    return host, path, rule, action, hits["allow"], hits["block"], tried


_FOUND = "host string, path string, rule string, action string, allow_pattern string, block_pattern string, tried int"


def _try_batch(index: Broadcast, names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int32()]
        for batch in it:
            found = [try_rules(u, index.value) for u in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return run


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict, pattern, tried).

    ``rule`` is the longest fitting host rule (of one written twice, the block rule decides) and gives the ``verdict``; where none
    fits, a block pattern without an allow pattern gives ``block`` and is named in ``pattern`` (of several the least by text),
    everything else is ``allow``. A null URL, or one without ``://``, has an empty host and path; a null URL fits nothing. Null and repeated
    ids are rows like others; other columns are not read; an empty table gives no rows; without rules everything is ``allow``.

    Rules are a list on the driver, indexed by how many of these URLs have each token. A list of up to RULE_BYTES is one
    broadcast and needs no shuffle; a longer one is applied in passes of RULE_BYTES each, whose findings are joined by row.
    """
    spark = pages.sparkSession
    ship_package(spark)
    if bad := [r for r in rules if r.action not in ("allow", "block") or not (r.text if r.pattern else r.text.partition("/")[0])]:
        raise ValueError(f"rules need an action and a host or pattern: {bad[:3]}")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    frequency = token_frequencies(read.select("url"), rules) if rules else {}
    blocks = in_blocks(rules)

    def applied(df: DataFrame, key: str, block: list[Rule]) -> DataFrame:
        index = spark.sparkContext.broadcast(indexed(block, frequency))
        schema = f"{key} {df.schema[key].dataType.simpleString()}, {_FOUND}"
        return df.mapInArrow(_try_batch(index, [p.split()[0] for p in schema.split(", ")]), schema)

    if len(blocks) == 1:
        found = applied(read, "page_id", blocks[0])
    else:
        stored = written(read.withColumn("row", F.monotonically_increasing_id()), "url-rows")
        passes = [written(applied(stored.select("row", "url"), "row", b), "url-pass") for b in blocks]
        both = passes[0]
        for p in passes[1:]:
            both = both.unionByName(p)
        best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule", "action")))
        hits = [F.min(c).alias(c) for c in ("allow_pattern", "block_pattern")]
        merged = both.groupBy("row").agg(F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"), *hits, F.sum("tried").cast("int").alias("tried"))
        found = stored.select("page_id", "row").join(merged, "row").select("*", "b.rule", "b.action")
    blocked = F.col("block_pattern").isNotNull() & F.col("allow_pattern").isNull()
    verdict = F.coalesce("action", F.when(blocked, "block").otherwise("allow"))
    pattern = F.when(F.col("rule").isNull(), F.coalesce("allow_pattern", "block_pattern"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), pattern.alias("pattern"), "tried")
