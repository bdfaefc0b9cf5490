"""WARC archives: one gzip member a record, written and read by tasks.

Writing: each task writes archives of its rows into a shared folder and reports their paths in a manifest table. A name
holds the task's attempt, so an attempt that is lost leaves a file that no manifest lists. Of equal payloads of
`least` bytes or more, the row with the smallest page_id becomes a response and the others revisit it.

Reading: each archive of the manifest is read front to back in chunks. A member is decompressed as its bytes arrive,
its block is framed by Content-Length, and both digests are verified; a wrong or cut record raises ValueError, and so
does an archive that holds more or fewer records than its manifest says. Memory is bounded by one record.

Null html is an empty payload, null url an empty target. A null page_id comes first in order; rows repeated under the
smallest page_id are all responses. A very long page is one record. An empty table gives no archives and no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import nat, new_path, staged

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"
#: An archive is closed and a new one begun beyond this size.
ROLL_BYTES = 256 << 20
CHUNK = 256 << 10
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, payload binary"


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """pages with digest, and the page_id they revisit if they do.

    Only digests that occur twice need the join. They are written first, so the planner sees whether they are few
    enough to be sent to the pages; else it joins by shuffle, and splits hot digests.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), nat("page_id").alias("id"))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = staged(shared.filter("n > 1").select("digest", "first"), "warc-shared")
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP head alone, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    lines = VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(lines + CRLF + block + CRLF + CRLF) + z.flush()


def written(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Archives of all pages under `folder`; returns their manifest: path, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, n, size, k = None, "", 0, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.warc.gz"
                    out, n, size, k = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, k + 1
                member = record(page_id, url or "", payload, digest, refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ROLL_BYTES:
                    out.close()
                    yield pa.record_batch({"path": [f"{folder}/{name}"], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [f"{folder}/{name}"], "records": [n]})

    return staged(planned(pages, least).mapInArrow(run, "path string, records long"), "warc-manifest")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    z, held = zlib.decompressobj(31), bytearray()
    fresh = True
    while chunk := stream.read(CHUNK):
        while chunk:
            held += z.decompress(chunk)
            fresh = False
            chunk = b""
            if z.eof:
                yield bytes(held)
                chunk, held, z, fresh = z.unused_data, bytearray(), zlib.decompressobj(31), True
    if not fresh:
        raise ValueError("the archive ends within a record")


def parsed(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record; verified."""
    head, found, rest = member.partition(CRLF + CRLF)
    version, *lines = head.split(CRLF)
    if version != VERSION or not found:
        raise ValueError("not a WARC record")
    fields = {k: v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != CRLF + CRLF:
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the record's length is not its Content-Length")
    if fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong block digest")
    http, _, payload = block.partition(CRLF + CRLF)
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong payload digest")
    return fields, http, payload


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of a manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, path, payload (empty for revisits, or if not asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = n = 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for member in members(stream):
                        fields, http, payload = parsed(member)
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((_id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), path, payload if payloads else b""))
                        n += 1
                        held += len(rows[-1][-1]) + 200
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if n != records:
                    raise ValueError(f"{path} holds {n} records, and its manifest says {records}")
                if rows:
                    yield table(rows)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "payload"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    spark = manifest.sparkSession
    # An archive a task, as far as Spark's default number of tasks goes.
    return manifest.select("path", "records").repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(run, RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = written(pages, new_path(spark, "warc"))
    back = read(manifest, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to") != -(1 << 63), F.col("refers_to")).alias("refers_to"))
