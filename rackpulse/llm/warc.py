"""Web archives: write pages as WARC, rewrite whole-file gzip streams as one gzip member per record, read back by index.

Three Spark steps over files in the shared folder:

1. ``write_archives``: every page becomes a record; each task streams its records into archives that are one gzip stream
   each (``*.mono.warc.gz``), a new one every ``archive_bytes`` of records.
2. ``normalise``: each archive is inflated once, in pieces; every record goes out as a gzip member of its own
   (``*.warc.gz``), and its offset and length go to a side file (``*.warc.idx``, a JSON line per record).
3. ``read_records``: Spark reads the side files and fetches each record by its offset alone; payload digests are computed
   again from what is read and compared with the headers.

Files are written under a task's own name and moved into place, so a task that is run again leaves the same files.

Defined cases: a null page is an empty payload; of equal payloads of at least ``REVISIT_BYTES`` bytes the smallest page_id
holds the response and the others are revisits (rows that repeat that page_id are responses too; if all ids are null, all
are); a null url leaves its header out, control characters in one are percent-encoded; an empty table gives no
archive and an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.common import new_path, store, table

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
_PIECE = 1 << 18
INDEX = "archive string, offset long, length long, record_type string, page_id long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- what becomes of each page

def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (bytes), payload_bytes, payload_digest, record_type, refers_to."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    base = pages.select("page_id", "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"),
                        F.sha2(html, 256).alias("payload_digest"))
    copies = store(base.where(F.col("payload_bytes") >= REVISIT_BYTES)
                   .groupBy(F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n_bytes"))
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                   "warc-copies")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (base.join(copies, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("n_bytes")),
                      "left")
            .select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                    F.when(later, "revisit").otherwise("response").alias("record_type"),
                    F.when(later, F.col("first")).alias("refers_to")))


# ---- files

def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class _Moved:
    """A file that appears under its name only when complete."""

    def __init__(self, path: str) -> None:
        from pyspark import TaskContext
        self.fs, self.path = _filesystem(path)
        context = TaskContext.get()
        self.own = f"{self.path}.{context.taskAttemptId() if context else 0}.part"
        self.out, self.size = self.fs.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def _record(row: dict) -> bytes:
    """One WARC record of a page."""
    page, revisit = row["page_id"], row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else row["payload"])
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
              ("WARC-Date", DATE)]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
               ("X-Payload-Length", str(row["payload_bytes"])),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``plan_records`` as whole-file gzip streams; returns (archive, records), stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        out, gz, done, raw, n = None, None, [], 0, 0
        part = TaskContext.get().partitionId()

        def close() -> None:
            out.write(gz.flush())
            out.close()
            done.append((out.path.rsplit("/", 1)[-1], n))

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(k) for k in names), strict=True):
                if out is None:
                    out = _Moved(f"{folder}/{part:06d}-{len(done):04d}.mono.warc.gz")
                    gz, raw, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = _record({k: v.as_py() for k, v in zip(names, values, strict=True)})
                out.write(gz.compress(data))
                raw, n = raw + len(data), n + 1
                if raw >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array([x[0] for x in done], pa.string()),
                                          "records": pa.array([x[1] for x in done], pa.int64())})

    _make(folder)
    return store(records.mapInArrow(run, "archive string, records long"), "warc-archives")


def _make(folder: str) -> None:
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)


class RecordSplitter:
    """Cuts an inflated WARC stream, fed in pieces, into records: calls begin(head), body(bytes) and end() in turn.
    Holds a header or one piece at a time, never a whole record."""

    def __init__(self, begin: Callable, body: Callable, end: Callable) -> None:
        self.begin, self.body, self.end, self.held, self.left = begin, body, end, b"", 0

    def feed(self, data: bytes) -> None:
        self.held += data
        while self.held:
            if self.left:
                part = self.held[:self.left]
                self.body(part)
                self.left -= len(part)
                self.held = self.held[len(part):]
                if not self.left:
                    self.end()
                continue
            at = self.held.find(b"\r\n\r\n")
            if at < 0:
                return
            head, self.held = self.held[:at + 4], self.held[at + 4:]
            self.left = int(headers(head)["content-length"]) + 4  # and the two line ends after the block
            self.begin(head)

    def close(self) -> None:
        if self.held or self.left:
            raise ValueError("archive ends inside a record")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _page(uri: str) -> int | None:
    digits = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _inflate(source) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, in pieces."""
    gz, fresh = zlib.decompressobj(31), True
    while data := source.read(_PIECE):
        while data:
            fresh = False
            piece = gz.decompress(data, _PIECE * 4)
            if piece:
                yield piece
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz, fresh = gz.unused_data, zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("gzip stream is cut off")


def normalise_file(folder: str, name: str) -> int:
    """Rewrite one archive as a member per record, with its index; returns the number of records."""
    target = name.replace(".mono.warc.gz", ".warc.gz")
    fs, path = _filesystem(f"{folder}/{name}")
    out, index = _Moved(f"{folder}/{target}"), _Moved(f"{folder}/{target.removesuffix('.gz')}.idx")
    state: dict = {"n": 0}

    def begin(head: bytes) -> None:
        state.update(gz=zlib.compressobj(LEVEL, zlib.DEFLATED, 31), offset=out.size, head=headers(head))
        out.write(state["gz"].compress(head))

    def body(data: bytes) -> None:
        out.write(state["gz"].compress(data))

    def end() -> None:
        out.write(state["gz"].flush())
        state["n"] += 1
        line = {"archive": target, "offset": state["offset"], "length": out.size - state["offset"],
                "record_type": state["head"]["warc-type"], "page_id": _page(state["head"]["warc-record-id"])}
        index.write(json.dumps(line).encode() + b"\n")

    splitter = RecordSplitter(begin, body, end)
    with fs.open_input_stream(path, compression=None) as source:
        for piece in _inflate(source):
            splitter.feed(piece)
    splitter.close()
    out.close()
    index.close()
    return state["n"]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite all archives listed in ``archives``; returns (archive, records), stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("archive").to_pylist()
            yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string()), "records": pa.array(
                [normalise_file(folder, x) for x in names], pa.int64())})

    tasks = max(1, archives.count())
    return store(archives.select("archive").repartition(tasks).mapInArrow(run, "archive string, records long"),
                 "warc-normalised")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a folder's normalised archives, each fetched by its entry in the side files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["archive"] != name:
                    name = entry["archive"]
                    fs, path = _filesystem(f"{folder}/{name}")
                    source = fs.open_input_file(path)
                source.seek(entry["offset"])
                rows.append(_read_back(source.read(entry["length"])))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return spark.read.schema(INDEX).option("pathGlobFilter", "*.warc.idx").json(folder).mapInArrow(run, RECORD)


def _read_back(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    at = data.index(b"\r\n\r\n") + 4
    head = headers(data[:at])
    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
    if head["warc-type"] == "response":
        payload = data[data.index(b"\r\n\r\n", at) + 4:-4]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
    return {"page_id": _page(head["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _page(head["warc-refers-to"]) if "warc-refers-to" in head else None}


def round_trip(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, normalise the archives and read them back."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    normalise(write_archives(plan_records(pages), folder, archive_bytes), folder)
    return read_records(spark, folder)


def op9_warc(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
