"""Resampling of documents towards a target: hashed n-gram weights, Gumbel scores, and ranks by a distributed LSD radix sort.

A document's weight is the sum of its features' gains, where a gain is the scaled log ratio of a bucket's share among the target's
features to its share among all documents'. Weights come from one array of gains; features are hashed many at a time: the
CRC of a run of words follows from the CRCs of its words, so each distinct word of a batch is read once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm.common import ship_package, text_batches, written
from panelforge.llm.words import word_lists

BUCKETS = 10_000
#: Words hashed at once, and bytes of text taken from a batch at once.
AT_ONCE, TEXT_BYTES = 200_000, 4 << 20
#: Words of up to so many bytes are combined by tables, longer ones by reading them.
TABLE_BYTES = 64


def _shift_tables() -> np.ndarray:
    """tables[n, k, b]: what n more bytes make of a CRC that is byte b at place k and zero elsewhere."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0xEDB88320), np.uint32(0))
    tables = np.empty((TABLE_BYTES + 1, 4, 256), np.uint32)
    tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(TABLE_BYTES):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & 0xFF]
    return tables


_TABLES = _shift_tables()


def _joined(front: np.ndarray, back: np.ndarray, sizes: np.ndarray, words: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """CRCs of strings with CRC ``front``, each followed by texts[words] with CRC ``back`` and ``sizes`` bytes."""
    short = np.minimum(sizes, TABLE_BYTES)
    out = back.copy()
    for k in range(4):
        out ^= _TABLES[short, k, (front >> np.uint32(8 * k)) & np.uint32(0xFF)]
    for i in np.flatnonzero(sizes > TABLE_BYTES).tolist():
        out[i] = zlib.crc32(texts[words[i]], int(front[i]))
    return out


def hashed_runs(pieces: list[tuple[int, int, list[bytes]]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each run of 1 to 3 words in ``pieces`` of (document, words carried over, words).

    Carried words stand before a piece's own; only runs that end in an own word count.
    """
    flat = [w for _, _, words in pieces for w in words]
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in flat), np.int64, len(flat))
    texts = list(place)
    spaced = [w + b" " for w in texts]
    crc = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))[ids]
    crc_spaced = np.fromiter(map(zlib.crc32, spaced), np.uint32, len(texts))[ids]
    size = np.fromiter(map(len, texts), np.int64, len(texts))[ids]
    counts = np.array([len(words) for _, _, words in pieces], np.int64)
    starts = np.cumsum(counts) - counts
    doc = np.repeat(np.array([d for d, _, _ in pieces], np.int64), counts)
    within = np.arange(len(flat)) - np.repeat(starts, counts)
    own = within >= np.repeat(np.array([c for _, c, _ in pieces], np.int64), counts)
    two = _joined(crc_spaced[:-1], crc[1:], size[1:], ids[1:], texts)
    two_spaced = _joined(crc_spaced[:-2], crc_spaced[1:-1], size[1:-1] + 1, ids[1:-1], spaced)
    three = _joined(two_spaced, crc[2:], size[2:], ids[2:], texts)
    docs, hashes = [], []
    for n, values in enumerate((crc, two, three)):
        ends = np.arange(n, len(flat))
        good = own[ends] & (within[ends] >= n)
        docs.append(doc[ends][good])
        hashes.append(values[good])
    return np.concatenate(docs), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64)


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Pieces of the texts, some AT_ONCE words at a time; a long text's later pieces start with the two words before them."""
    held, n = [], 0
    for d, text in enumerate(texts):
        last: list[bytes] = []
        for words in word_lists(text):
            for at in range(0, len(words), AT_ONCE):
                own = words[at : at + AT_ONCE]
                held.append((d, len(last), last + own))
                last = (last + own)[-2:]
                n += len(own)
                if n >= AT_ONCE:
                    yield held
                    held, n = [], 0
    if n:
        yield held


def _count_buckets(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_batches(it, 0, TEXT_BYTES):
            for pieces in _pieces(batch.column(0).to_pylist()):
                total += np.bincount(hashed_runs(pieces, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(df: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket: every task gives one array of ``buckets`` numbers at most."""
    ship_package(df.sparkSession)
    parts = df.select(text_col).mapInArrow(_count_buckets(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, both shares with one more feature in each bucket."""
    k = float(len(corpus))
    up = (target + 1.0) * (float(corpus.sum()) + k)
    down = (corpus + 1.0) * (float(target.sum()) + k)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def _weigh(gain: Broadcast):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(it, 1, TEXT_BYTES):
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for pieces in _pieces(batch.column(1).to_pylist()):
                doc, bucket = hashed_runs(pieces, len(gain.value))
                np.add.at(weight, doc, gain.value[bucket])
                for d, carried, w in pieces:
                    words[d] += len(w) - carried
            features = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            columns = [batch.column(0), *map(pa.array, (words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    ship_package(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(_weigh(docs.sparkSession.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(seed:key)."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((bits + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: Bits of a digit, and rows of a block of the counting sort (more where that would make over MOST_BLOCKS blocks).
DIGIT_BITS, BLOCK_ROWS, MOST_BLOCKS = 11, 1_000, 100_000
_TOP = -(1 << 63)


def digits_of(df: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """Digit columns, least significant first, of the composite key (column, descending) ...; columns are long, nulls last.

    Each column takes as many digits as the span of its values needs.
    """
    least = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c, _ in keys for f in (F.min, F.max)], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c, _ in keys]).first()
    out: list[Column] = []
    for c, descending in reversed(keys):
        low, high = least[f"min_{c}"], least[f"max_{c}"]
        if low is not None:
            if high - low < 1 << 63:
                value, bits = (F.lit(high) - F.col(c) if descending else F.col(c) - F.lit(low)), (high - low).bit_length()
            else:  # the span overflows a long: the sign bit turned over, all 64 bits
                value, bits = F.col(c).bitwiseXOR(F.lit(_TOP)), 64
                value = F.bitwise_not(value) if descending else value
            n = -(-bits // DIGIT_BITS)
            width = -(-bits // n) if n else 0
            out += [F.coalesce(F.shiftrightunsigned(value, i * width).bitwiseAND((1 << width) - 1), F.lit(0)).cast("int") for i in range(n)]
        if least[f"null_{c}"]:
            out.append(F.col(c).isNull().cast("int"))
    return out


def counting_pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """The stored ``rows`` with ``pos`` replaced by their places after one stable counting sort by ``digit``.

    Blocks of ``block_rows`` places count their digits. Where a digit starts follows from the counts of smaller digits, at most
    2 ** DIGIT_BITS totals; where a block's share of it starts, from the blocks before; the place within it, from the old order. Rows
    are shuffled once, by (digit, block), of which none holds more than ``block_rows`` rows.
    """
    keyed = rows.withColumn("_digit", digit).withColumn("_block", F.floor(F.col("pos") / block_rows))
    counts = keyed.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
    totals, starts, at = dict(map(tuple, counts.groupBy("_digit").agg(F.sum("_n")).collect())), [], 0
    for d in sorted(totals):
        starts.append((d, at))
        at += totals[d]
    first = rows.sparkSession.createDataFrame(starts, "_digit int, _first long")
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", earlier).join(F.broadcast(first), "_digit").select("_digit", "_block", (F.col("_first") + F.col("_before")).alias("_start"))
    local = F.row_number().over(W.partitionBy("_digit", "_block").orderBy("pos")) - 1
    placed = keyed.withColumn("_local", local).join(offsets, ["_digit", "_block"])
    return placed.select(*[c for c in rows.columns if c != "pos"], (F.col("_start") + F.col("_local")).alias("pos"))


def radix_ranked(df: DataFrame, keys: list[tuple[str, bool]]) -> tuple[DataFrame, int]:
    """(stored ``df`` with ``pos``, its row's place from 0 in the order of ``keys``, rows). Equal keys keep the order of the stored rows."""
    rows = written(df.withColumn("pos", F.monotonically_increasing_id()), "radix-rows")
    n = rows.count()
    if not n:
        return rows, 0
    digits = digits_of(rows, keys) or [F.lit(0)]
    for digit in digits:
        rows = written(counting_pass(rows, digit, max(BLOCK_ROWS, n // MOST_BLOCKS)), "radix-pass")
    return rows, n


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_features, weight, score, rank); ``rank`` counts the drawn documents from 1, others have null.

    Of the N documents with at least ``least_words`` words, floor(percent N / 100) are drawn without replacement, by the largest scores
    (weight plus seeded Gumbel noise); equal scores go to the smaller id, null ids come last and take their noise from the word
    ``null``. Rows that repeat an id share their noise; equal ones follow each other in no stated order. Null or empty texts have no
    features and weight 0. Other columns are not read; an empty table gives no rows; an empty target is a uniform one.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    noise = gumbel(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed)
    scored = written(weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise), "importance-scores")
    large = F.col("n_words") >= least_words
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked, n = radix_ranked(scored.where(large).select(*columns), [("score", True), ("doc_id", False)])
    rank = F.when(F.col("pos") < percent * n // 100, F.col("pos") + 1)
    small = scored.where(~large).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.cast("long").alias("rank")).unionByName(small)
