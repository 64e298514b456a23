"""WARC archives: written once per page with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own. The index row of a record (file, offset, length, URL, digest) is all a
reader needs to fetch it. Pages with equal payloads are stored once, in the record of the largest page_id; the
others are revisit records that name it.

Null html is an empty payload, a null URL an empty target. Null page_ids never count as largest unless all of the
payload's are null; then all are responses. Rows that repeat the largest page_id are responses, too. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsekit.llm.shared import Work, read

#: Records at most this far apart are fetched in one read, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: An archive of more bytes is read by several tasks.
SPAN_BYTES = 64 << 20
#: Of every record, for replay without clocks.
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, for writing and reading from tasks; Spark writes local ones with one slash."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder) if folder.startswith("file:/") else folder)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_type(pages: DataFrame, work: Work, least_bytes: int = 0) -> DataFrame:
    """Adds ``last``: the page_id of the response with the same payload; null for payloads under ``least_bytes``."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.sha1(F.col("payload").cast("binary")))
    last = work.keep(rows.groupBy("key").agg(F.max("page_id").alias("last")), "last")
    # Both sides are plain shuffles, so adaptive execution can split a payload that many pages share.
    joined = rows.join(last, "key").drop("key")
    return joined.withColumn("last", F.when(F.octet_length("payload") >= least_bytes, F.col("last")))


def _record(page_id: int | None, url: str, payload: bytes, last: int | None) -> tuple[bytes, str, str]:
    digest = sha1_base32(payload)
    kind = "response" if last is None or page_id == last else "revisit"
    body = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    lines += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: <urn:page:{last}>", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 4, mtime=0), digest, kind


def write_archives(typed: DataFrame, folder: str) -> DataFrame:
    """One archive a task, under a name of the attempt's own: a task that runs again writes another file, and the
    index names that of the attempt that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        offset, out = 0, None
        for batch in batches:
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            rows: list[tuple] = []
            for page_id, url, payload, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, digest, kind = _record(page_id, url, payload.encode(), last)
                out.write(data)
                rows.append((name, offset, len(data), url, digest, page_id, kind))
                offset += len(data)
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["file", "offset", "length", "url", "digest", "page_id", "record_type"],
                )
        if out:
            out.close()

    return typed.select("page_id", "url", "payload", "last").mapInArrow(run, INDEX)


def parse_record(member: bytes) -> dict:
    """Fields of one gzip member; the digest of a response is checked against its payload."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    if rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and sha1_base32(payload) != digest:
        raise ValueError("the payload's digest is wrong")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(fields.get("X-Payload-Length", len(payload))),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }


def ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, records) that cover sorted records (offset, length), near ones together."""
    held: list[tuple[int, int]] = []
    for offset, length in rows:
        if held and (offset - sum(held[-1]) > GAP_BYTES or offset + length - held[0][0] > READ_BYTES):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], sum(held[-1]), held


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of the selected index rows, by byte-range reads in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            by: dict[str, list[tuple[int, int]]] = {}
            for f, o, n in zip(files, offsets, lengths, strict=True):
                by.setdefault(f, []).append((o, n))
            for name, records in by.items():
                with system.open_input_file(f"{base}/{name}") as source:
                    for start, end, held in ranges(records):
                        data = source.read_at(end - start, start)
                        found = [parse_record(data[o - start : o - start + n]) for o, n in held]
                        if not payload:
                            found = [x | {"payload": None} for x in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[k] for x in found], t) for k, t in zip(names, types, strict=True)], names
                        )

    span = F.floor(F.col("offset") / SPAN_BYTES)
    placed = index.repartition("file", span).sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(run, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op2")
    folder = f"{work.path}/archives"
    index = work.keep(write_archives(with_type(read(spark, sf_dir, "pages"), work), folder), "index")
    return read_records(index, folder, payload=False).drop("payload", "url")

