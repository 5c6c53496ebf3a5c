"""WARC archives: a writer that turns repeated payloads into revisits, and a sequential reader.

The writer puts one gzip member per record into files in the folder that all executors share. Files are named after the
task attempt that wrote them and listed in a manifest, which is settled before anything is read: a lost or repeated
attempt leaves files that no manifest names. The reader goes through a file once, inflating piece by piece, frames
blocks by Content-Length and checks every digest; memory holds one record at a time.

Payloads stay where they were scanned: only ids and digests are shuffled to find the revisits, which reach the writers by
broadcast while they are few enough (``runtime.small``) and by a join on the id beyond that.

Null html is an empty payload, as is empty html; a null url is written as an empty target. Long payloads are written and
read whole, one record in memory at a time. Records without an id are responses and are never referred to. Rows that
agree in id and payload count as the same record, and each of them is written; of equal payloads the smallest id is the
response, whatever the order of rows. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm.runtime import batch, filesystem, map_batches, settle, shared_dir, small

#: Payloads below this many bytes are always responses.
LEAST_REVISIT = 100
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that is not framed as WARC, or whose digests don't agree."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 1) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, whose length tells the payload's, and leaves the payload out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=~')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, read and inflated piece by piece."""
    z, parts, raw = zlib.decompressobj(31), [], b""
    while True:
        raw = raw or stream.read(READ_BYTES)
        if not raw:
            if parts or z.unconsumed_tail:
                raise WarcError("the archive ends within a record")
            return
        parts.append(z.decompress(raw))
        raw = b""
        if z.eof:
            yield b"".join(parts)
            raw, parts, z = z.unused_data, [], zlib.decompressobj(31)


def parse(member: bytes) -> dict:
    """A record's fields, after its framing and digests have been checked."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't fit the record")
    if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block doesn't have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload doesn't have its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number("warc-record-id"), "url": unquote(fields.get("warc-target-uri", "")), "payload_bytes": full, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "payload": payload}


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row; return the settled manifest (path, records, bytes)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("d"))
    large = settle(large.distinct())
    first = settle(large.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("d", "refers_to"))
    revisits = large.join(first, "d").filter("page_id <> refers_to").select("page_id", F.lower(F.hex("d")).alias("digest"), "refers_to")
    told = rows.join(small(settle(revisits)), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches):
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode(), digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield batch({"path": ([x[0] for x in done], pa.string()), "records": ([x[1] for x in done], pa.int64()), "bytes": ([x[2] for x in done], pa.int64())})

    return settle(map_batches(told, write, "path string, records long, bytes long").withColumn("folder", F.lit(folder)))


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the manifest's files, in sequence within each: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def read(batches):
        for b in batches:
            for path, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, _ = filesystem(folder)
                held, n = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        held.append(x := parse(member))
                        n += len(x["payload"]) if payloads else 200
                        if n >= 4 << 20:
                            yield batch({k: ([x[k] for x in held], kinds[k]) for k in names})
                            held, n = [], 0
                yield batch({k: ([x[k] for x in held], kinds[k]) for k in names})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return map_batches(manifest.select("path", "folder").repartition(max(1, spark.sparkContext.defaultParallelism), "path"), read, schema)
