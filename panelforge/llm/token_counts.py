"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus.

1. Each block of documents is split into pre-tokens. A block keeps its list of distinct pre-tokens and, for each
   document, (pre-token, frequency) pairs.
2. The blocks' lists are dealt by pre-token, so that equal pre-tokens meet; the model counts the pieces of each once.
3. The counts go back to their blocks, where a document's tokens are the sum of frequency * pieces.

Between tasks travel the lists (one entry for each pre-token of a block, not of a document) and the compressed pairs.
A very frequent pre-token is one entry of each block, and a very long text fills a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import ship_package, text_batches, written
from panelforge.llm.pieces import parts, splitter

#: Bytes of text that are split at once, and that share one list of distinct pre-tokens.
SPLIT_BYTES, BLOCK_BYTES = 1 << 20, 24 << 20


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four compressed byte planes."""
    v = values.astype("<u4")
    head = np.array([len(v)], "<u8").tobytes()
    return head + pa.compress(v.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(v) else head


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


class _Block:
    """Documents that share one list of distinct pre-tokens."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.sizes: list[int] = []
        self.specials: list[int] = []
        self.words: dict[int, str] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document, hash, frequency
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str], split) -> None:
        segments, owner = [], []
        base = len(self.sizes)
        for i, t in enumerate(texts):
            own = split.between_specials(t)
            self.sizes.append(len(t.encode()))
            self.specials.append(len(own) - 1)
            cut = [p for o in own for p in parts(o)]
            segments += cut
            owner += [i] * len(cut)
        self.ids.append(ids)
        self.bytes += sum(self.sizes[base:])
        at = 0
        while at < len(segments):
            end, size = at, 0
            while end < len(segments) and (end == at or size + len(segments[end]) <= SPLIT_BYTES):
                size += len(segments[end])
                end += 1
            self._count(segments[at:end], np.array(owner[at:end], np.int64) + base, split)
            at = end

    def _count(self, segments: list[str], owner: np.ndarray, split) -> None:
        joined, number, starts, ends, hashes = split.split([split.normalized(s) for s in segments])
        if not len(hashes):
            return
        new, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        for h, a, b in zip(new.tolist(), starts[at].tolist(), ends[at].tolist()):
            if h not in self.words:
                self.words[h] = joined[a:b]
        pair, n = np.unique(owner[number] * len(new) + back, return_counts=True)
        self.parts.append((pair // len(new), new[pair % len(new)], n))

    def row(self, block: int, slices: int) -> dict:
        """Pre-tokens stand in the order of their slice; a document's pairs stand in the order of the list, as differences."""
        known = np.fromiter(self.words, np.uint64, len(self.words))
        part = (known % np.uint64(slices)).astype(np.int64)
        order = np.lexsort((known, part))
        known, words = known[order], list(self.words.values())
        words = [words[i] for i in order.tolist()]
        by_hash = np.argsort(known)
        docs = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        h = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[2] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        at = by_hash[np.searchsorted(known, h, sorter=by_hash)] if len(h) else np.zeros(0, np.int64)
        order = np.lexsort((at, docs))
        docs, at, n = docs[order], at[order], n[order]
        step = np.diff(at, prepend=0)
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        step[first] = at[first]
        return {
            "block": block,
            "ids": pa.concat_arrays(self.ids).to_pylist(),
            "sizes": packed(np.array(self.sizes)),
            "specials": packed(np.array(self.specials)),
            "pairs": packed(np.bincount(docs, minlength=len(self.sizes))),
            "steps": packed(step),
            "freqs": packed(n),
            "words": "".join(words),
            "lens": packed(np.fromiter(map(len, words), np.int64, len(words))),
            "slices": packed(np.bincount(part, minlength=slices)),
        }


_BLOCKS = (
    "block long, ids array<long>, sizes binary, specials binary, pairs binary, steps binary, freqs binary, words string, lens binary, slices binary"
)


def _batch(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


_BLOCK_SCHEMA = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("sizes", "specials", "pairs", "steps", "freqs")]]
    + [("words", pa.string()), ("lens", pa.binary()), ("slices", pa.binary())]
)


def _to_blocks(path: str, slices: int, block_bytes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made, block = splitter(path), 0, _Block()
        base = TaskContext.get().partitionId() << 32
        for batch in text_batches(it, "text", SPLIT_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if block.sizes and block.bytes + sum(map(len, texts)) > block_bytes:
                yield _batch([block.row(base + made, slices)], _BLOCK_SCHEMA)
                made, block = made + 1, _Block()
            block.add(batch.column(0), texts, split)
        if block.sizes:
            yield _batch([block.row(base + made, slices)], _BLOCK_SCHEMA)

    return run


def _deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's list of pre-tokens by slices."""
    for batch in it:
        for block, words, lens, slices in zip(*(c.to_pylist() for c in batch.columns)):
            lens, sizes = unpacked(lens), unpacked(slices).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lens.astype(np.int64))])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            used = np.flatnonzero(sizes).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([block] * len(used), pa.int64()),
                    pa.array([words[ends[edge[p]] : ends[edge[p + 1]]] for p in used], pa.string()),
                    pa.array([lens[edge[p] : edge[p + 1]].astype("<u4").tobytes() for p in used], pa.binary()),
                ],
                names=["slice", "block", "words", "lens"],
            )


def _count(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(path), {}
        for batch in it:
            out = []
            for words, lens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ends = np.cumsum(np.frombuffer(lens, "<u4").astype(np.int64)).tolist()
                counts, a = np.empty(len(ends), "<u4"), 0
                for k, b in enumerate(ends):
                    w, a = words[a:b], b
                    n = known.get(w)
                    if n is None:
                        n = known[w] = len(split.ids_of(w))
                    counts[k] = n
                out.append(counts.tobytes() if counts.size and counts.max() > 255 else counts.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["slice", "block", "counts"])

    return run


def _sum(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = batch.to_pylist()
        for r in rows:
            sizes = unpacked(r["slices"]).astype(np.int64)
            got = {c["slice"]: c["counts"] for c in r["parts"] or ()}
            pieces = [
                np.frombuffer(got[p], np.uint8 if len(got[p]) == n else "<u4").astype(np.int64) for p, n in enumerate(sizes.tolist()) if n
            ]
            pieces = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
            pairs = unpacked(r["pairs"]).astype(np.int64)
            step = unpacked(r["steps"]).astype(np.int64)
            at = np.cumsum(step)
            first = (np.cumsum(pairs) - pairs)[pairs > 0]
            at -= np.repeat(at[first] - step[first], pairs[pairs > 0])
            tokens = pieces[at] * unpacked(r["freqs"]).astype(np.int64)
            doc = np.repeat(np.arange(len(pairs)), pairs)
            total = np.bincount(doc, tokens, len(pairs)).astype(np.int64) + unpacked(r["specials"]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array(unpacked(r["sizes"]).astype(np.int64)), pa.array(total)],
                names=["doc_id", "n_bytes", "n_tokens"],
            )


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit), as the library counts without added special tokens.

    ``vocabulary`` is a file of the tokenizers library whose model encodes each pre-token by itself. A null or empty text
    has 0 bytes and 0 tokens; strings of special tokens inside a text count as one token each, as the library does.
    Repeated ids and texts each give their own row, a null id stays null, an empty table gives no rows; other columns of
    ``docs`` are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(read.mapInArrow(_to_blocks(vocabulary, slices, block_bytes), _BLOCKS), "token-blocks")
    lists = blocks.select("block", "words", "lens", "slices").mapInArrow(_deal, "slice int, block long, words string, lens binary")
    counts = lists.repartition(slices, "slice").mapInArrow(_count(vocabulary), "slice int, block long, counts binary")
    # A block has one row for each slice, so what is gathered here is one entry for each of its distinct pre-tokens.
    parts = counts.groupBy("block").agg(F.collect_list(F.struct("slice", "counts")).alias("parts"))
    joined = blocks.select("block", "ids", "sizes", "specials", "pairs", "steps", "freqs", "slices").join(parts, "block", "left")
    out = joined.mapInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
