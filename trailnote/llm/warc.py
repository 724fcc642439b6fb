"""WARC archives as files of the shared folder, read back as a chunked record table.

Writing: payloads become rows of (record, chunk number, at most CHUNK bytes) where the pages
are scanned, so a join or a Python task never meets one whole; a page's own cell in the scan
is the only one. Each task appends the chunks of its records to one archive of its own, under
a name that no other attempt uses, with an incremental digest that is held against the
scan's, and returns where each record begins. That manifest is written
as a table, so a lost executor or a second attempt leaves at most an unlisted file.

Reading: the manifest's records are dealt out in runs of about RUN_BYTES; a task opens the archive,
seeks, and emits rows (record_id, chunk_no, data) of at most CHUNK bytes while it feeds an
incremental SHA-1; the last chunk of a record carries its digest and length. No payload is
ever held whole, and a wrong digest or length raises.

Equal payloads of at least LEAST bytes are stored once: the row with the largest page_id is
the response, the others are revisit records that refer to it.

Defined cases: null html counts as empty; rows repeated whole are written as often as they
come (several responses with the largest page_id, all equal); a null page_id is written with
an empty identifier and is a response unless its payload is shared with a row that has one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailnote.llm.common import landed, mapped, shared_dir

LEAST = 1000
CHUNK = 64 * 1024
RUN_BYTES = 4 << 20
#: Bytes of archives that one task reads; the rows that name them are too few for Spark to tell.
TASK_BYTES = 32 << 20
_PAGE = "WARC-X-Page-Id"
_FULL = "WARC-X-Payload-Length"


def labelled(pages: DataFrame) -> DataFrame:
    """(record, page_id, url, payload_bytes, payload_digest, refers_to, chunk_no, data): chunk rows of each page, a record's one after the other; refers_to only for revisits, which have one row without data."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.cast("binary").alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    # Only payloads that occur more than once are joined; the counts are combined before the shuffle.
    shared = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    shared = landed(shared.select("payload_digest", "first_id"), "shared-payloads")
    last = F.greatest(F.ceil(F.col("payload_bytes") / CHUNK).cast("int") - 1, F.lit(0))
    chunks = rows.withColumn("record", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunks = chunks.select("record", "page_id", "url", "payload_bytes", "payload_digest", "chunk_no", F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("data"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= LEAST), F.col("first_id"))
    joined = chunks.join(shared, "payload_digest", "left").select("record", "page_id", "url", "payload_bytes", "payload_digest", refers.alias("refers_to"), "chunk_no", "data")
    told = joined.filter("refers_to IS NULL OR chunk_no = 0").withColumn("data", F.when(F.col("refers_to").isNull(), F.col("data")))
    # The join may mix the chunks of equal payloads; it never parts those of one page, which come from one task of the scan.
    return told.sortWithinPartitions("payload_digest", "record", "chunk_no")


def _clean(url: str | None) -> str:
    """One header line's worth of a URL."""
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def _head(page: int | None, url: str | None, size: int, digest: str, refers: int | None, record: str) -> bytes:
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{record}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        (_PAGE, "" if page is None else str(page)),
        (_FULL, str(size)),
        *([] if refers is None else [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-X-Refers-To-Page-Id", str(refers))]),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(size if refers is None else 0)),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes labelled() rows; the manifest (archive, at, size, run) of their records. A record without all its bytes, or with others, raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc"
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        out, at, length, left, page, digest, sha = None, 0, 0, 0, None, "", hashlib.sha1()
        for batch in batches:
            places, sizes = [], []
            for number, size, told, refers, id_, url, data in zip(*(batch.column(c) for c in ("chunk_no", "payload_bytes", "payload_digest", "refers_to", "page_id", "url", "data"))):
                if number.as_py() == 0:
                    if left:
                        raise ValueError(f"page {page}: {left} bytes of the payload are missing")
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}")
                    page, digest, refers, sha = id_.as_py(), told.as_py(), refers.as_py(), hashlib.sha1()
                    left = size.as_py() if refers is None else 0
                    head = _head(page, url.as_py(), size.as_py(), digest, refers, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{at}")))
                    out.write(head)
                    length = len(head) + left + 4
                    places.append(at)
                    sizes.append(length)
                    at += length
                    if not left:
                        out.write(b"\r\n\r\n")
                        continue
                chunk = data.as_buffer()
                sha.update(chunk)
                out.write(chunk)
                left -= chunk.size
                if left <= 0:
                    if left or sha.hexdigest() != digest:
                        raise ValueError(f"page {page}: the payload changed on its way to the archive")
                    out.write(b"\r\n\r\n")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x // RUN_BYTES for x in places], pa.int64())], ["archive", "at", "size", "run"])
        if left:
            raise ValueError(f"page {page}: {left} bytes of the payload are missing")
        if out is not None:
            out.close()

    return mapped(rows, run, "archive string, at long, size long, run long")


class _Reader:
    """Sequential reads of one run of records with a small buffer."""

    def __init__(self, source, at: int):
        self.source, self.buffer = source, b""
        source.seek(at)

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\r\n")) < 0:
            more = self.source.read(4096)
            if not more:
                raise ValueError("the archive ends inside a record's header")
            self.buffer += more
        got, self.buffer = self.buffer[:end], self.buffer[end + 2 :]
        return got

    def take(self, n: int) -> bytes:
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got if got else self.source.read(n)


def records(reader: _Reader, end: int) -> Iterator[tuple]:
    """(record_id, chunk_no, data, digest so far or final, is_last, header) of each chunk up to place end of the archive."""
    while reader.source.tell() - len(reader.buffer) < end:
        if reader.line() != b"WARC/1.1":
            raise ValueError("no record begins here")
        header = {}
        while text := reader.line():
            key, _, value = text.decode().partition(": ")
            header[key] = value
        left, sha, number = int(header["Content-Length"]), hashlib.sha1(), 0
        while True:
            data = reader.take(min(left, CHUNK)) if left else b""
            if left and not data:
                raise ValueError("the archive ends inside a payload")
            left -= len(data)
            sha.update(data)
            if not left and header["WARC-Type"] == "response" and "sha1:" + sha.hexdigest() != header["WARC-Payload-Digest"]:
                raise ValueError(f"{header['WARC-Record-ID']}: the payload does not match its digest")
            yield header["WARC-Record-ID"], number, data, sha.hexdigest(), not left, header
            number += 1
            if not left:
                break
        if reader.line() or reader.line():
            raise ValueError("a record does not end where its length says")


def read_chunks(manifest: DataFrame, folder: str) -> DataFrame:
    """The chunked record table."""
    runs = manifest.groupBy("archive", "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _CHUNK_TYPES)], _CHUNK_NAMES)

        for batch in batches:
            for archive, at, end in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{base}/{archive}") as source:
                    rows, held, whole = [], 0, 0
                    for record, number, data, sha, last, header in records(_Reader(source, at), end):
                        whole = (0 if number == 0 else whole) + len(data)
                        revisit = header["WARC-Type"] == "revisit"
                        page, refers = header[_PAGE], header.get("WARC-X-Refers-To-Page-Id")
                        rows.append((record, number, data, last, header["WARC-Type"], int(page) if page else None, int(header[_FULL]) if revisit else whole, header["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha, int(refers) if refers else None))
                        held += len(data)
                        if held >= RUN_BYTES or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    tasks = max(1, -(-(manifest.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    return mapped(runs.select("archive", "at", "end").repartition(tasks, "archive", "at"), run, "record_id string, chunk_no long, data binary, is_last boolean, record_type string, page_id long, bytes_so_far long, digest_so_far string, refers_to long")


_CHUNK_NAMES = ["record_id", "chunk_no", "data", "is_last", "record_type", "page_id", "bytes_so_far", "digest_so_far", "refers_to"]
_CHUNK_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def archived(pages: DataFrame) -> tuple[DataFrame, str]:
    """(manifest, folder) of new archives of all pages."""
    folder = f"{shared_dir(pages.sparkSession)}/trailnote-warc-{uuid.uuid4().hex}"
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    return landed(write_archives(labelled(pages), folder), "manifest"), folder


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, told from the chunk rows: a response's length is that of its chunks."""
    manifest, folder = archived(pages)
    last = F.max_by(F.struct("page_id", "bytes_so_far", "digest_so_far", "record_type", "refers_to"), "chunk_no").alias("last")
    rows = read_chunks(manifest, folder).groupBy("record_id").agg(F.sum(F.length("data")).alias("stored"), last)
    size = F.when(F.col("last.record_type") == "response", F.col("stored")).otherwise(F.col("last.bytes_so_far"))
    return rows.select("last.page_id", size.cast("long").alias("payload_bytes"), F.col("last.digest_so_far").alias("payload_digest"), "last.record_type", "last.refers_to")
