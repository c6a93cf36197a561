"""Licence scan by a generalised suffix automaton over the words of licence notices.

A text streams through the automaton word by word. The state after each word tells the longest stretch of notice words
that ends there (the matching statistics). Long stretches are anchors; anchors of one notice that follow each other in
text and notice are chained, and a chain that covers enough of its notice labels the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import ship_package, text_batches
from panelforge.llm.license_texts import NOTICES, PHRASES
from panelforge.llm.words import word_lists

#: An anchor has at least ANCHOR words; anchors of a chain stand at most REACH words apart; a chain covers COVER of its notice.
ANCHOR, REACH, COVER = 4, 12, 0.8


class SuffixAutomaton:
    """All word stretches of several texts; each state knows where its stretches end in which text."""

    def __init__(self, texts: Sequence[Sequence[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len, ends = [-1], [0], [set()]

        def state(length: int, nxt: dict[bytes, int], link: int) -> int:
            self.next.append(nxt)
            self.len.append(length)
            self.link.append(link)
            ends.append(set())
            return len(self.len) - 1

        def split(p: int, w: bytes, q: int) -> int:
            """A state for the stretches of q that are one word longer than p's."""
            c = state(self.len[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = c
            while p >= 0 and self.next[p].get(w) == q:
                self.next[p][w] = c
                p = self.link[p]
            return c

        for t, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                q = self.next[last].get(w)
                if q is not None:
                    last = q if self.len[q] == self.len[last] + 1 else split(last, w, q)
                else:
                    p, last = last, state(self.len[last] + 1, {}, 0)
                    while p >= 0 and w not in self.next[p]:
                        self.next[p][w] = last
                        p = self.link[p]
                    if p >= 0:
                        q = self.next[p][w]
                        self.link[last] = q if self.len[q] == self.len[p] + 1 else split(p, w, q)
                ends[last].add((t, i))
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            ends[self.link[s]] |= ends[s]
        ends[0] = set()
        self.ends = [sorted(e) for e in ends]

    def find(self, words: Sequence[bytes]) -> int:
        s = 0
        for w in words:
            s = self.next[s][w]
        return s


class Scanner:
    def __init__(self, phrases: Mapping[str, str], notices: Sequence[tuple[str, str]]):
        split = lambda t: [w for part in word_lists(t) for w in part]
        self.phrases = [(split(p), label) for p, label in phrases.items()]
        texts = [p for p, _ in self.phrases] + [split(t) for _, t in notices]
        self.labels = [label for _, label in self.phrases] + [label for label, _ in notices]
        self.sizes = [len(t) for t in texts]
        self.auto = SuffixAutomaton(texts)
        self.words = frozenset(w for t in texts for w in t)
        # Phrases that end a stretch of a state: those on its chain of suffix links.
        at = {self.auto.find(p): i for i, (p, _) in enumerate(self.phrases)}
        self.ending: list[list[int]] = []
        for s in range(len(self.auto.len)):
            found, q = [], s
            while q > 0:
                found += [at[q]] if q in at else []
                q = self.auto.link[q]
            self.ending.append(found)

    def scan(self, text: str | None):
        """(words, base places, first, last, base labels, labels, score, spans) of a text."""
        nxt, link, size, words = self.auto.next, self.auto.link, self.auto.len, self.words
        n, s, length = 0, 0, 0
        starts: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int]] = []  # last word, length, state
        for part in word_lists(text):
            for i, w in enumerate(part, n):
                if w not in words:
                    if s:
                        if length >= ANCHOR:
                            anchors.append((i - 1, length, s))
                        s = length = 0
                    continue
                if w not in nxt[s] and length >= ANCHOR:
                    anchors.append((i - 1, length, s))
                while s and w not in nxt[s]:
                    s = link[s]
                    length = size[s]
                s = nxt[s].get(w, 0)
                length = length + 1 if s else 0
                for k in self.ending[s]:
                    if self.sizes[k] <= length:
                        starts.append((i - self.sizes[k] + 1, k))
            n += len(part)
        if length >= ANCHOR:
            anchors.append((n - 1, length, s))
        base = sorted({self.labels[k] for _, k in starts})
        spans = self._chains(anchors) if anchors else []
        labels = sorted({*base, *(x["label"] for x in spans)})
        score = 1.0 if starts else max((x["coverage"] for x in spans), default=0.0)
        at = [p for p, _ in starts]
        return n, len(starts), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score, spans

    def _chains(self, anchors: list[tuple[int, int, int]]) -> list[dict]:
        by_notice: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # start in text, start in notice, length
        for last, length, s in anchors:
            for t, end in self.auto.ends[s]:
                if t >= len(self.phrases):
                    by_notice[t].append((last - length + 1, end - length + 1, length))
        found = []
        for t, own in by_notice.items():
            live: list[list] = []  # covered words, first, last in text, last in notice
            done: list[list] = []
            for a, b, length in sorted(own):
                best = [length, a, a + length - 1, b + length - 1]
                done += [c for c in live if a - c[2] > REACH]
                live = [c for c in live if a - c[2] <= REACH]
                for c in live:
                    over = max(0, c[2] - a + 1, c[3] - b + 1)  # words that both anchors hold
                    if over < length and c[0] + length - over > best[0] and c[3] < b + length - 1:
                        best = [c[0] + length - over, c[1], a + length - 1, b + length - 1]
                live.append(best)
            found += [(c[0] / self.sizes[t], c[0], c[1], c[2], t) for c in done + live if c[0] >= COVER * self.sizes[t]]
        # Of chains over the same words the one that covers most stays; those that stay are disjoint and kept in order.
        out: list[tuple] = []
        firsts: list[int] = []
        for c in sorted(found, key=lambda c: (-c[1], -c[0], c[2], c[4])):
            k = bisect_right(firsts, c[3])
            if not k or out[k - 1][3] < c[2]:
                out.insert(k, c)
                firsts.insert(k, c[2])
        return [{"label": self.labels[t], "first": a, "last": b, "covered": k, "coverage": min(1.0, f)} for f, k, a, b, t in out]


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), notices)


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, covered: long, coverage: double>>"
)


def _scan(phrases: tuple, notices: tuple):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(phrases, notices).scan
        for batch in text_batches(it, "text", 8 << 20):
            cols = zip(*map(scan, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, _TYPES)]], names=["doc_id", *_NAMES])

    return run


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Sequence[tuple[str, str]] = tuple(NOTICES),
) -> DataFrame:
    """One row per row of ``docs``: words, places of base phrases, labels, score and the covered spans of notices.

    Places overlap freely and count each. A null or empty text has no words, no labels and score 0; labels are '' then and
    word places null. Rows with a repeated or null id give their own rows; an empty table gives none; other columns are not read.
    """
    ship_package(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(_scan(tuple(phrases.items()), tuple(notices)), SCHEMA)
