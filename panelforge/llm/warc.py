"""WARC archives with an index first: offset, length, URL and digest of each record are stored when it is written.

Records are gzip members of their own, so each byte range reads alone. A reader takes the selected index rows, deals them
by file and place, and joins neighbouring ranges into few reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import shared_folder, ship_package, text_batches, written
from panelforge.llm.exact_dedup import mark_copies
from panelforge.llm.files import TaskFiles, at

REVISIT_BYTES = 1000
FILE_BYTES, BATCH_BYTES = 128 << 20, 4 << 20
#: Ranges closer than GAP are read together, up to SPAN bytes at once.
GAP, SPAN = 64 << 10, 4 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(text: str | None) -> int | None:
    value = re.fullmatch(r"<urn:page:(none|-?\d+)>", text or "")
    return None if value is None or value[1] == "none" else int(value[1])


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"] if revisit else []
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, url, payload bytes, digest, type, refers_to, payload) of one record; the stored payload must fit its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    refers = _page(fields.get("WARC-Refers-To"))
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers, payload.decode() if kind == "response" else None


def _write(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, stream, offset = TaskFiles(folder, ".warc.gz"), None, None, 0
        for batch in text_batches(it, "html", BATCH_BYTES):
            rows = []
            for page, url, html, keep, kept in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                revisit = len(payload) >= REVISIT_BYTES and not kept
                data = gzip.compress(record(page, url, payload, keep, revisit), 6, mtime=0)
                if stream is None:
                    (name, stream), offset = files.open(), 0
                stream.write(data)
                digest = hashlib.sha1(payload).hexdigest()
                rows.append((name, offset, len(data), page, url, digest, "revisit" if revisit else "response", keep if revisit else None))
                offset += len(data)
                if offset >= FILE_BYTES:
                    stream.close()
                    stream = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)
        if stream is not None:
            stream.close()

    return run


_INDEX_NAMES = ["file", "offset", "length", "page_id", "url", "payload_digest", "record_type", "refers_to"]
_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` to ``folder`` and return the stored index.

    Of equal payloads of at least REVISIT_BYTES bytes the row with the largest id is the response, the others are revisits of it;
    smaller payloads are all responses. Null html is an empty payload; a null URL leaves its header out; a null or
    repeated id is written as it is (of rows that repeat the winning id one is the response). An empty table writes
    nothing. Other columns are not read.
    """
    ship_package(pages.sparkSession)
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marked = mark_copies(read, F.sha2("html", 256), "page_id", ("digest", "keep_id", "copies", "kept")).select("page_id", "url", "html", "keep_id", "kept")
    return written(marked.mapInArrow(_write(folder), INDEX), "warc-index")


def _read(folder: str, payloads: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = at(folder)

        def load(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            file, first = group[0][:2]
            with system.open_input_file(f"{root}/{file}") as f:
                data = f.read_at(group[-1][1] + group[-1][2] - first, first)
            rows = [parse(gzip.decompress(data[o - first : o - first + n])) for _, o, n in group]
            cols = [*zip(*rows)]
            cols[6] = cols[6] if payloads else [None] * len(rows)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_RECORD_NAMES)

        group: list[tuple[str, int, int]] = []
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                near = group and row[0] == group[-1][0] and row[1] - (group[-1][1] + group[-1][2]) <= GAP
                if group and not (near and row[1] + row[2] - group[0][1] <= SPAN):
                    yield load(group)
                    group = []
                group.append(row)
        if group:
            yield load(group)

    return run


_RECORD_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the ``selected`` index rows, from the archives; a revisit has no payload of its own."""
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = selected.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / SPAN))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(_read(folder, payloads), RECORDS)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read all records back (without payloads)."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, id_col, url_col, html_col), folder, payloads=False)
