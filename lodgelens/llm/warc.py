"""WARC archives: writing, normalising and reading.

``write_archives`` writes a WARC/1.1 record per page into monolithic archives
(one gzip stream over the whole file). ``normalise`` inflates such a stream
once, rewrites every record as its own gzip member and writes a sidecar index
(record offset and length), so single records can be read by seeking.
``read_records`` parses the members back. Pages with equal payloads of at
least ``min_bytes`` bytes keep one response (smallest id); the others become
revisit records that name it.

Files are written with pyarrow's file systems to the shared folder under a
name given by partition and serial number, first as a partial file that is
then renamed, so a repeated task replaces its file by the same bytes.
Monolithic archives and indexes are read with Spark's binaryFile reader,
single records by seeking. A file holds at most about
``file_bytes`` of payload.

Defined cases: null html is an empty payload, null url an empty target; the
page id must be unique for a revisit to name one response (rows that repeat
an id are all responses or name that same id), a row with a null id is a
response; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgelens.llm.files import filesystem, new_file
from lodgelens.llm.shared import shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # fixed, so that a repeated task writes the same bytes


def record_bytes(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    body = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {quote(url, safe=':/?&=#%~+,;@!$()*')}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def split_records(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the records of an inflated archive, by their Content-Length."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        size = int(data[data.rindex(b"Content-Length: ", at, head + 2) + 16:head].split(b"\r\n")[0])
        yield at, head + 4 + size + 4
        at = head + 8 + size


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _gzip(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _write(uri: str, file_bytes: int, level: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, serial, size = TaskContext.get().partitionId(), 0, 0
    packer, chunks = zlib.compressobj(level, zlib.DEFLATED, 31), []

    def close():
        name = f"pages-{part:06d}-{serial:05d}.warc.gz"
        with new_file(uri, name) as out:
            out.write(b"".join([*chunks, packer.flush()]))
        return pd.DataFrame({"name": [name]})

    for pdf in batches:
        for page_id, url, html, digest, refers in zip(*(pdf[c] for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
            payload = (html or "").encode()
            chunks.append(packer.compress(record_bytes(page_id or "", url or "", payload, digest, refers)))
            size += len(payload) + 1
            if size >= file_bytes:
                yield close()
                packer, chunks, serial, size = zlib.compressobj(level, zlib.DEFLATED, 31), [], serial + 1, 0
    if size:
        yield close()


def inflated(content: bytes) -> bytes:
    """The bytes of all gzip members of a file, one after another. A file that
    ends inside a member, or goes on with something else, raises."""
    parts = []
    while content:
        stream = zlib.decompressobj(31)
        parts.append(stream.decompress(content) + stream.flush())
        if not stream.eof:
            raise zlib.error("gzip file ends inside a member")
        content = stream.unused_data
    return b"".join(parts)


def _normalise(uri: str, level: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            data = inflated(content)  # usually one member: the whole file is one stream
            members, index, at = [], [], 0
            for start, end in split_records(data):
                member = _gzip(data[start:end], level)
                index.append((at, len(member)))
                members.append(member)
                at += len(member)
            name = path.rsplit("/", 1)[-1]
            with new_file(f"{uri}/members", name) as out:
                out.write(b"".join(members))
            with new_file(f"{uri}/index", name.replace(".warc.gz", ".idx")) as out:
                out.write(b"".join(struct.pack("<QI", *x) for x in index))
            yield pd.DataFrame({"name": [name], "records": [len(index)]})


def _read(uri: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    system, folder = filesystem(uri)
    for pdf in batches:
        for stem, index in zip(pdf["stem"], pdf["index"]):
            rows = []
            with system.open_input_file(f"{folder}/members/{stem}.warc.gz") as archive:
                for at, length in struct.iter_unpack("<QI", index):
                    archive.seek(at)
                    record = zlib.decompress(archive.read(length), 31)
                    cut = record.index(b"\r\n\r\n")
                    h = _headers(record[:cut])
                    body = record[cut + 4:-4]
                    kind = h["WARC-Type"]
                    strip = lambda x: x[len("<urn:page:"):-1]
                    digest = h["WARC-Payload-Digest"].split(":")[1]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
                    rows.append((strip(h["WARC-Record-ID"]), unquote(h["WARC-Target-URI"]), kind, digest,
                                 int(h["X-Payload-Length"]) if kind == "revisit" else len(body),
                                 strip(h["WARC-Refers-To"]) if kind == "revisit" else None, body if kind == "response" else None))
            yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


def with_refers(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for responses).

    Only (digest, smallest id) of repeated payloads is grouped, with map-side
    combine; the join back on the digest is an ordinary equi-join that
    adaptive execution can split when a third of the pages are one payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"),
                     F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    sizes = pages.select("page_id", F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).alias("n"))
    firsts = (sizes.where(F.col("n") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return (p.join(firsts.hint("merge"), "payload_digest", "left")
            .withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first"))


def write_archives(pages: DataFrame, uri: str, file_bytes: int = 8 << 20, min_bytes: int = 100, level: int = 3) -> int:
    """Write monolithic archives under ``uri``; the number of files."""
    rows = with_refers(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(lambda it: _write(uri, file_bytes, level, it), "name string").count()


def normalise(spark: SparkSession, source: str, target: str, level: int = 3) -> int:
    """Member-wise archives and sidecar indexes under ``target``; the number of records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select("path", "content")
    return files.mapInPandas(lambda it: _normalise(target, level, it), "name string, records long").agg(
        F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to
    (ids as text) and the payload of responses: each index file is a row whose
    task seeks its archive's records."""
    stem = F.regexp_extract("path", r"([^/]+)\.idx$", 1).alias("stem")
    index = spark.read.format("binaryFile").load(f"{target}/index").select(stem, F.col("content").alias("index"))
    return index.mapInPandas(lambda it: _read(target, it),
                             "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame | None:
    """Write, normalise and read back all pages; None for an empty table."""
    spark = pages.sparkSession
    raw, tidy = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    if write_archives(pages, raw, min_bytes=min_bytes) == 0:
        return None
    normalise(spark, raw, tidy)
    return read_records(spark, tidy)
