"""Benchmark decontamination by BM25 over an inverted index of the test items, pruned by block maxima (block-max WAND).

Every text is read as passages of PASSAGE words that overlap by half. A passage is a query against the index of test
items. The index knows, for each word, its largest contribution to any item, and in each block of items: a passage whose words
cannot reach the threshold is skipped, then each block that it cannot reach, and only the rest is scored.

Retrieved pairs are verified: the word shingles of the item's question and of its answer must both be found in the text, anywhere in
it. So each item's threshold is the least score that the best passage of an accepted text can have: if OVERLAP of a half's shingles
must be there, one of them scores at least as much as the heaviest shingle that may not be missing, and it stands whole in
some passage, as PASSAGE is at least twice a shingle less two. No text that the verification accepts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm.common import distinct, give_back_memory, ship_package, text_batches, written
from panelforge.llm.words import word_lists

PASSAGE = 8
K1, B = 1.2, 0.75
BLOCK = 4
#: Of the words that stand in more than COMMON blocks, those that together stay below every threshold enter the first bound by their largest
#: contribution to any item, not by their lists.
COMMON = 64
#: Words of texts that are searched at once, list entries that are summed at once, and pairs of passage and block that are scored at once.
SPAN, ENTRIES, PAIRS = 1 << 18, 1 << 21, 1 << 14
SHINGLE, OVERLAP = 5, 0.8
#: An index holds at most so many bytes of test items (about ten times that in memory); more items make more indexes, each with a pass over the texts.
INDEX_BYTES = 8 << 20
BATCH_BYTES = 2 << 20


def all_words(text: str | None) -> list[bytes]:
    return [w for part in word_lists(text) for w in part]


def shingles(words: Sequence, k: int = SHINGLE) -> set[tuple]:
    """Distinct shingles; fewer words are one shingle, no words none."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def hashed(terms: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` term numbers; runs with a word of no item (-1) are left out."""
    if len(terms) < k:
        return np.zeros(0, np.uint64)
    n, out = len(terms) - k + 1, np.full(len(terms) - k + 1, np.uint64(k))
    good = np.ones(n, bool)
    for i in range(k):
        part = terms[i : i + n]
        good &= part >= 0
        out = (out ^ (part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out[good]


@dataclass(frozen=True)
class Index:
    items: list[int]
    terms: dict[bytes, int]
    highest: np.ndarray  # of each term over all items
    size: np.ndarray  # of each term: blocks of items that have it
    start: np.ndarray  # of each term: its first entry in the next two
    block: np.ndarray
    value: np.ndarray  # largest contribution in that block
    keys: np.ndarray  # item * terms + term, sorted
    contribution: np.ndarray  # of each key
    thresholds: np.ndarray
    least: np.ndarray  # of each block: smallest threshold
    parts: list[tuple[int, np.ndarray, int, np.ndarray]]  # of each item: shingle length and hashed shingles of question and answer

    def lowest(self) -> float:
        return float(self.thresholds.min()) if len(self.thresholds) else np.inf

    def scores(self, items: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """What each term contributes to its item."""
        key = items * len(self.terms) + terms
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.contribution[at], 0.0)


def least_found(half: list[int], own: dict[int, float]) -> float:
    """The score that one found shingle of a half has at least, where OVERLAP of them are found: the heaviest that may not be missing."""
    k = min(SHINGLE, len(half))
    weights = sorted((sum(own[t] for t in set(s)) for s in {tuple(half[i : i + k]) for i in range(len(half) - k + 1)}), reverse=True)
    return weights[int((1 - OVERLAP) * len(weights) + 1e-9)]


def build_index(items: list[tuple[int, str | None, str | None]]) -> Index:
    """Index of (item, question, answer). Items without words are left out: nothing can repeat them."""
    words = [(i, all_words(q), all_words(a)) for i, q, a in items]
    words = [(i, q, a) for i, q, a in words if q or a]
    words.sort(key=lambda x: (len(x[1]) + len(x[2]), x[0]))
    terms: dict[bytes, int] = {}
    numbers = [([terms.setdefault(w, len(terms)) for w in q], [terms.setdefault(w, len(terms)) for w in a]) for _, q, a in words]
    n = len(numbers)
    df = np.zeros(len(terms))
    for q, a in numbers:
        df[list({*q, *a})] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    mean = sum(len(q) + len(a) for q, a in numbers) / max(n, 1)
    keys, contribution, thresholds, parts = [], [], [], []
    for i, (q, a) in enumerate(numbers):
        norm = K1 * (1 - B + B * (len(q) + len(a)) / mean)
        t, c = np.unique(np.array(q + a, np.int64), return_counts=True)
        v = idf[t] * c * (K1 + 1) / (c + norm)
        own = dict(zip(t.tolist(), v.tolist()))
        # The bound is lowered a little, so that sums in another order do not miss it.
        thresholds.append((1 - 1e-9) * max(least_found(half, own) for half in (q, a) if half))
        keys.append(i * len(terms) + t)
        contribution.append(v)
        sizes = [min(SHINGLE, len(half)) for half in (q, a)]
        parts.append(tuple(x for k, half in zip(sizes, (q, a)) for x in (k, distinct(hashed(np.array(half, np.int64), k)) if k else np.zeros(0, np.uint64))))
    keys = np.concatenate([*keys, np.zeros(0, np.int64)])
    contribution = np.concatenate([*contribution, np.zeros(0)])
    item, term = keys // max(1, len(terms)), keys % max(1, len(terms))
    order = np.lexsort((item, term))
    group = term[order] * (n // BLOCK + 1) + item[order] // BLOCK
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    value = np.maximum.reduceat(contribution[order], first) if len(first) else np.zeros(0)
    size = np.bincount(term[order][first], minlength=len(terms))
    start = np.cumsum(size) - size
    highest = np.maximum.reduceat(value, start) if len(start) else np.zeros(0)
    least = np.array([min(thresholds[k : k + BLOCK]) for k in range(0, n, BLOCK)])
    return Index([i for i, _, _ in words], terms, highest, size, start, item[order][first] // BLOCK, value, keys, contribution, np.array(thresholds), least, parts)


def retrieve(index: Index, docs: list[np.ndarray]) -> list[dict[int, float]]:
    """For each text the items (by place in the index) with a passage above their threshold, and the largest score.

    A text is an array of term numbers, -1 for words of no item.
    """
    step, found = PASSAGE // 2, [{} for _ in docs]
    if not len(index.items):
        return found
    spans = [(d, t[a : a + SPAN + step]) for d, t in enumerate(docs) for a in range(0, max(1, len(t) - step), SPAN) if len(t)]
    owner, at = [], 0
    while at < len(spans):
        end, size = at, 0
        while end < len(spans) and (end == at or size + len(spans[end][1]) <= SPAN):
            size += len(spans[end][1])
            end += 1
        owner = np.array([d for d, _ in spans[at:end]])
        _passages(index, owner, [t for _, t in spans[at:end]], found)
        at = end
    return found


def _passages(index: Index, owner: np.ndarray, texts: list[np.ndarray], found: list[dict[int, float]]) -> None:
    step, lowest = PASSAGE // 2, index.lowest() - 1e-9
    lens = np.array([len(t) for t in texts])
    count = np.maximum(1, -(-lens // step) - 1)  # passages of each text
    base = np.cumsum(count) - count
    terms = np.concatenate(texts)
    if not (terms >= 0).any():
        return
    use = np.flatnonzero(terms >= 0)
    half = (np.arange(len(terms)) - np.repeat(np.cumsum(lens) - lens, lens))[use] // step
    first, last = np.repeat(base, lens)[use], np.repeat(base + count - 1, lens)[use]
    terms = terms[use]
    # Each half belongs to the passage that it begins and to the one that it ends; a word counts once in a passage.
    key = distinct(np.concatenate([np.minimum(first + half, last), np.maximum(first + half - 1, first)]) * len(index.terms) + np.tile(terms, 2))
    w, t = key // len(index.terms), key % len(index.terms)
    total = int(count.sum())
    keep = np.bincount(w, index.highest[t], total)[w] >= lowest
    w, t = w[keep], t[keep]
    # The commonest words of a passage go unwalked as long as they cannot reach any threshold by themselves.
    order = np.lexsort((-index.size[t], w))
    upto = np.cumsum(index.highest[t[order]])
    upto -= np.concatenate(([0.0], upto))[np.searchsorted(w, w[order])]
    common = np.zeros(len(t), bool)
    common[order] = (upto < lowest - 1e-6) & (index.size[t[order]] > COMMON)
    rest = np.bincount(w, np.where(common, index.highest[t], 0.0), total)
    # Passages that are left, numbered without gaps; their words stand in a row.
    lead = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
    begin, passage = np.flatnonzero(lead), w[lead]
    w = np.cumsum(lead) - 1
    words_of = np.diff(np.append(begin, len(w)))
    rest = rest[passage]
    row = np.flatnonzero(~common)
    cost = np.cumsum(index.size[t[row]])
    n, at = len(index.least), 0
    while at < len(row):
        # Whole passages, with a bounded number of list entries and of (passage, block) sums.
        end = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + ENTRIES, side="right"))
        end = min(max(end, at + 1), int(np.searchsorted(w[row], w[row[at]] + max(1, ENTRIES // n))))
        end = int(np.searchsorted(w[row], w[row[min(end, len(row) - 1)]])) if end < len(row) else end
        end = end if end > at else int(np.searchsorted(w[row], w[row[at]], side="right"))
        own = row[at:end]
        size = index.size[t[own]]
        entry = np.arange(int(size.sum())) + np.repeat(index.start[t[own]] - np.cumsum(size) + size, size)
        low, high = w[own[0]], w[own[-1]] + 1
        sums = np.bincount((np.repeat(w[own], size) - low) * n + index.block[entry], index.value[entry], (high - low) * n).reshape(-1, n)
        # A block with none of the walked words has the rest at most, which is below every threshold.
        p, b = np.nonzero((sums + rest[low:high, None] >= index.least - 1e-6) & (sums > 0))
        for k in range(0, len(p), PAIRS):
            _score(index, p[k : k + PAIRS] + low, b[k : k + PAIRS], t, begin, words_of, owner[np.searchsorted(base, passage, side="right") - 1], found)
        at = end


def _score(index: Index, p: np.ndarray, b: np.ndarray, t: np.ndarray, begin: np.ndarray, words_of: np.ndarray, doc: np.ndarray, found: list[dict[int, float]]) -> None:
    """Exact scores of pairs of a passage and a block, for each item of the block."""
    n = words_of[p]
    which = np.repeat(np.arange(len(p)), n)
    term = t[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[p], n)]
    for j in range(BLOCK):
        item = b * BLOCK + j
        score = np.bincount(which, index.scores(item[which], term), len(p))
        good = np.flatnonzero((item < len(index.items)) & (score >= index.thresholds[np.minimum(item, len(index.items) - 1)]))
        for d, i, v in zip(doc[p[good]].tolist(), item[good].tolist(), score[good].tolist()):
            found[d][i] = max(found[d].get(i, 0.0), v)


def verified(index: Index, terms: np.ndarray, found: dict[int, float]) -> list[tuple[int, float, float, float]]:
    """(item, score, question overlap, answer overlap) of retrieved items whose parts are both found in the text."""
    if not found:
        return []
    seen = {k: distinct(hashed(terms, k)) for k in {index.parts[i][at] for i in found for at in (0, 2)} if k}
    out = []
    for i, score in sorted(found.items()):
        k, question, m, answer = index.parts[i]
        q, a = (float(np.isin(part, seen[size]).mean()) if size else 1.0 for size, part in ((k, question), (m, answer)))
        if q >= OVERLAP and a >= OVERLAP:
            out.append((index.items[i], score, q, a))
    return out


def leaks_of(index: Index, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
    """For each text (item, score, question overlap, answer overlap) of the items that it repeats."""
    get = index.terms.get
    docs = []
    for text in texts:
        parts = [np.fromiter((get(w, -1) for w in part), np.int64, len(part)) for part in word_lists(text)]
        docs.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return [verified(index, terms, hits) for terms, hits in zip(docs, retrieve(index, docs))]


def _filter(shared, at: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in text_batches(it, at, BATCH_BYTES):
            yield batch.filter(pa.array([not hits for hits in leaks_of(shared.value, batch.column(at).to_pylist())], pa.bool_()))

    return run


def _search(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(it, "text", BATCH_BYTES):
            rows = []
            for doc, hits in zip(batch.column(0).to_pylist(), leaks_of(shared.value, batch.column(1).to_pylist())):
                rows += [(doc, *hit) for hit in hits]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            cols = [*zip(*rows)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def halves(text: str | None) -> tuple[str, str]:
    """Question and answer of an item that has only one text: the first half of its words and the rest; a short text is all question."""
    words = all_words(text)
    cut = (len(words) + 1) // 2 if len(words) >= 2 * SHINGLE else len(words)
    return b" ".join(words[:cut]).decode(), b" ".join(words[cut:]).decode()


def indexes(spark: SparkSession, items: DataFrame, item_col: str, question_col: str, answer_col: str | None, index_bytes: int) -> list:
    """Broadcast indexes of the test items, each of about ``index_bytes`` of text at most; the driver holds one part at a time."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.col(question_col).alias("question"), answer.alias("answer"))
    size = F.octet_length(F.coalesce("question", F.lit(""))) + F.octet_length(F.coalesce("answer", F.lit("")))
    total = tests.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts, out = max(1, -(-total // index_bytes)), []
    for k in range(parts):
        mine = tests.where(F.pmod(F.xxhash64("item", "question"), F.lit(parts)) == k).collect()
        triples = [(r["item"], *((r["question"], r["answer"]) if answer_col else halves(r["question"]))) for r in mine]
        out.append(spark.sparkContext.broadcast(build_index(triples)))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str = "text",
    answer_col: str | None = None,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each row of ``docs`` and test item that its text repeats.

    Without ``answer_col`` an item's words are halved into question and answer. Each index of test items is one pass over
    the texts. Null or empty texts and items match nothing; an item repeated under several ids is found under each;
    rows with a repeated or null id give their own rows; an empty table gives none; other columns are not read.
    """
    ship_package(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    hits = [read.mapInArrow(_search(i), schema) for i in indexes(docs.sparkSession, items, item_col, question_col, answer_col, index_bytes)]
    return reduce(DataFrame.unionAll, hits)


def drop_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, index_bytes: int = INDEX_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text repeats no test item; decided where a row stands, without a shuffle.

    Null and empty texts stay; null or repeated ids do not matter; each index of test items is one pass over the rows left.
    """
    ship_package(docs.sparkSession)
    at = docs.columns.index(text_col)
    parts = indexes(docs.sparkSession, items, item_col, question_col, answer_col, index_bytes)
    for k, i in enumerate(parts):
        docs = docs.mapInArrow(_filter(i, at), docs.schema)
        if k + 1 < len(parts):
            # Each part is a pass of its own, so that a task holds one index.
            docs = written(docs, "without-leaks")
    return docs
