"""Token ids of documents in binary files: Simple-8b words in segments, in ascending order of document id.

A file is a row of segments, each readable by itself: header, document ids, document lengths, table of ids by rank,
word offset of each block, words. The index has one row per segment with its file, byte range and number of ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from panelforge.llm import simple8b
from panelforge.llm.common import shared_folder, ship_package, text_batches, written
from panelforge.llm.files import TaskFiles, at
from panelforge.llm.pieces import encoder

MAGIC = b"S8BSEG01"
HEADER = struct.Struct("<8sQQQQ")  # magic, documents, ids, table entries, blocks
SEGMENT_IDS, FILE_BYTES, ENCODE_BYTES = 1 << 20, 128 << 20, 1 << 20
INDEX = "part int, seg int, file string, offset long, length long, n_ids long, n_docs long"


def segment(doc_ids: pa.Array, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment; a null document id is kept in a mask before the ids."""
    table, offsets, words = simple8b.encode(ids)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    head = HEADER.pack(MAGIC, len(lens), len(ids), len(table), len(offsets) - 1)
    return b"".join(
        [head, null.astype(np.uint8).tobytes(), doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]
        + [lens.astype("<i8").tobytes(), table.astype("<u4").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()]
    )


def read_segment(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a segment's bytes."""
    magic, docs, n, entries, blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    parts, place = [], HEADER.size
    for count, kind in ((docs, "u1"), (docs, "<i8"), (docs, "<i8"), (entries, "<u4"), (blocks + 1, "<i8")):
        parts.append(np.frombuffer(data, kind, count, place))
        place += parts[-1].nbytes
    words = np.frombuffer(data, "<u8", int(parts[4][-1]), place)
    return pa.array(parts[1], pa.int64(), mask=parts[0].astype(bool)), parts[2], simple8b.decode(parts[3], parts[4], words, n)


def _write(folder: str, path: str, end_id: int | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, enc, part = TaskFiles(folder, ".s8b"), encoder(path), TaskContext.get().partitionId()
        name, stream, offset, seg = None, None, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal name, stream, offset, seg
            if stream is None:
                (name, stream), offset = files.open(), 0
            lens, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = segment(pa.concat_arrays([h[0] for h in held]), lens, ids)
            stream.write(data)
            row = [[part], [seg], [name], [offset], [len(data)], [len(ids)], [len(lens)]]
            offset, seg = offset + len(data), seg + 1
            held.clear()
            if offset >= FILE_BYTES:
                stream.close()
                stream = None
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "seg", "file", "offset", "length", "n_ids", "n_docs"])

        for batch in text_batches(it, "text", ENCODE_BYTES):
            ids, lens = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                lens = lens + 1
            held.append((batch.column(0), lens, ids))
            if sum(len(h[2]) for h in held) >= SEGMENT_IDS:
                yield flush()
        if held:
            yield flush()
        if stream is not None:
            stream.close()

    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Write the token ids of all documents to ``folder``; returns the stored index, one row per segment.

    Files follow each other in ascending document id (nulls first). Rows are dealt by ranges of (id, row number), so that
    an id repeated many times is spread over ranges. Each row of ``docs`` is one document; null text is empty, an
    empty table writes nothing and gives an empty index. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    ordered = read.repartitionByRange(ranges, "doc_id", "_row").sortWithinPartitions("doc_id", "_row")
    return written(ordered.mapInArrow(_write(folder, vocabulary, end_id), INDEX), "token-index")


def _read(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = at(folder)
        for batch in it:
            for r in batch.to_pylist():
                with system.open_input_file(f"{root}/{r['file']}") as f:
                    doc_ids, lens, ids = read_segment(f.read_at(r["length"], r["offset"]))
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(ends - lens + r["start"]), pa.array(lens), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """One row per document of the indexed segments: (doc_id, start, n_tokens, ids_crc32), from the files."""
    files = index.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    # One row per task of the writer.
    before = files.select("part", F.coalesce(F.sum("_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    placed = index.withColumn("_own", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(before, "part")
    tasks = placed.select("file", "offset", "length", (F.col("_before") + F.col("_own")).alias("start"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, "file", "offset").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> DataFrame:
    """Write the token files of ``docs`` into a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, folder, id_col, text_col, end_id), folder)
