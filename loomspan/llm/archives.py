"""Web archives: a converter from legacy ARC to WARC, and a writer and reader of WARC files.

An ARC file begins with a version block, whose own header line declares its length and whose last line names the
fields of the header lines that follow: version 1 has five, version 2 ten. Each record is such a line, the declared
number of bytes, and a line feed. The converter makes of it a WARC/1.1 record: a URN from its content, the date in
ISO form, the type, SHA-1 digests of block and payload, and HTTP headers where the ARC record held none.

Defined cases: a null html is an empty payload; a null or blank url gives a record without target; white space and
characters beyond ASCII in a url are percent-encoded in the archive; a null id is archived and never refers to another;
repeated rows (same id, same payload) are archived as often as they occur, all of the type that their id has; payloads
of any length are written whole, one at a time; an empty table gives no rows; further columns are left out.

A WARC file is a sequence of gzip members, one for each record, so that a record can be read at its offset. Between two
stands an empty member, which any reader of gzip skips: Spark's text writer and reader take it for the separator of
lines. So files lie in any file system that Spark reaches, may have any size, are split between tasks, and no task
holds more than a batch of records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, sieved, temporary, unhexed, whole

# The header fields of ARC files, by version, and the profile of records that repeat a payload.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Between records: an empty gzip member, as the characters that have its bytes' numbers.
_BETWEEN = {"lineSep": gzip_member(b"").decode("latin-1"), "encoding": "ISO-8859-1"}
#: A batch that leaves a task's Python has about so many bytes, or one record.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def arc_file(records: list[tuple[str, bytes]], version: int = 1, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """A legacy archive of (url, content) records."""
    names = ARC_FIELDS[version]
    block = f"{version} 0 loomspan\n{' '.join(names)}\n\n".encode()

    def line(url: str, kind: str, size: int, offset: int) -> bytes:
        values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(size)}
        return (" ".join(values[x] for x in names) + "\n").encode()

    parts = [line(f"filedesc://{name}", "text/plain", len(block), 0), block]
    size = sum(map(len, parts))
    for url, content in records:
        parts += [line(url, "text/html", len(content), size), content, b"\n"]
        size += len(parts[-3]) + len(content) + 1
    return b"".join(parts)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, without its version block."""
    end = data.index(b"\n")
    size = int(data[:end].split()[-1])
    about = data[end + 1 : end + 1 + size].decode().split("\n")
    version, names = int(about[0].split()[0]), about[1].split()
    if names != ARC_FIELDS.get(version):
        raise ValueError(f"ARC version {version} with fields {names}")
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":  # blank lines may stand between records
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8").split(" ")
        if len(values) != len(names):
            raise ValueError(f"{len(names)} fields are declared, a header line has {len(values)}")
        fields = dict(zip(names, values))
        size = int(fields["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError("the archive ends inside a record")
        yield ArcRecord(fields, data[end + 1 : end + 1 + size])
        at = end + 1 + size


def http_response(payload: bytes, kind: str, code: str = "200") -> bytes:
    """The content of a record: a response as it came, so that what the payload holds is never taken for headers."""
    return f"HTTP/1.1 {code} OK\r\nContent-Type: {kind}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(content: bytes) -> tuple[bytes, bytes, bytes]:
    """Headers, the empty line behind them, and payload; old servers end lines with a line feed alone."""
    end = re.search(rb"\r?\n\r?\n", content)
    return (content[: end.start()], end[0], content[end.end() :]) if end else (content, b"", b"")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(row: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row}/{digest}')}>"


def to_warc(arc: ArcRecord, row: object, refers_to: object = None) -> bytes:
    """The WARC record, without the two line ends behind it. ``row`` is the id of the source row (None: none)."""
    f = arc.fields
    content = arc.content if arc.content.startswith(b"HTTP/") and split_http(arc.content)[1] else http_response(arc.content, f["Content-type"], f.get("Result-code", "200"))
    head, end, payload = split_http(content)
    digest = base32_sha1(payload)
    block = head + end + (b"" if refers_to is not None else payload)
    d = f["Archive-date"]
    out = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(row, digest)}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-IP-Address: {f['IP-address']}"]
    out += [f"WARC-Target-URI: {f['URL']}"] * (f["URL"] != "-")
    out += [f"WARC-Source-Row: {row}"] * (row is not None)
    if refers_to is not None:
        out += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"WARC-Refers-To-Source-Row: {refers_to}"]
    out += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(out).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; headers that don't fit their block are an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"the block of {headers['WARC-Record-ID']} is damaged")
        yield headers, block
        at = end + 8 + size


def same_payloads(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Distinct (id, sha, refers_to) of the rows that repeat an earlier payload; made of hashes and ids alone."""
    data = whole(payload_col).cast("binary")
    hashed = pages.select(F.col(id_col).alias("id"), unhexed(F.sha1(data)).alias("sha"), unhexed(F.sha2(data, 256)).alias("sha256"), F.octet_length(data).alias("size"))
    hashed = hashed.where(F.col("size") >= least_bytes)
    first = hashed.groupBy("sha", "sha256").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, ["sha", "sha256"]).where("id != refers_to").select("id", "sha", "refers_to").distinct()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES of rows whose bytes ``size`` tells."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """WARC files of all pages below ``path``, which any Hadoop file system may hold.

    Only rows that repeat a payload need to know another row, and of that its id. The other pages aren't shuffled;
    those are, by their own id and hash, so a payload of very many pages is dealt over all tasks.
    """
    revisits = same_payloads(pages, id_col, payload_col, least_bytes)
    data = whole(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), data.alias("html"), unhexed(F.sha1(data.cast("binary"))).alias("sha"))
    key = F.xxhash64("id", "sha")
    marked = sieved(rows, key, revisits.select(key.alias("k")), pages.count())
    columns = ["id", "url", "html", "refers_to"]
    again = marked.where("hit").join(revisits, ["id", "sha"], "left").select(*columns)
    rows = marked.where(~F.col("hit")).withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType)).select(*columns).unionByName(again)

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        n = 0
        for batch in batches:
            for i, u, h, r in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)):
                n += 1
                legacy = arc_file([(quote(u.as_py() or "", safe=SAFE) or "-", http_response(h.as_py(), "text/html"))], version=1 + n % 2)
                for arc in read_arc(legacy):
                    yield (gzip_member(to_warc(arc, i.as_py(), r.as_py()) + RECORD_END),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(converted(batches), pa.schema([("value", pa.binary())]), lambda row: len(row[0]))

    # The cast keeps the bytes as they are.
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.options(**_BETWEEN, compression="none").text(path)


SAFE = "".join(map(chr, range(33, 127)))


def read_archives(spark, path: str, id_type: T.DataType) -> DataFrame:
    """Per record: id, url, date, payload_bytes, payload_digest, record_type, refers_to, and the payload (null in revisits)."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("url", T.StringType()), T.StructField("date", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type), T.StructField("payload", T.BinaryType())])
    whole_number = isinstance(id_type, T.IntegralType)
    arrow_id = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8()}.get(type(id_type), pa.string())
    parse = (lambda x: None if x is None else int(x)) if whole_number else (lambda x: x)
    arrow = pa.schema([("id", arrow_id), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", arrow_id), ("payload", pa.binary())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for member in batch.column(0):
                for h, block in read_warc(zlib.decompress(member.as_py(), 31)):
                    head, _, payload = split_http(block)
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response":
                        size = len(payload)
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
                    else:
                        size, payload = int(next(x for x in head.splitlines() if x.lower().startswith(b"content-length:")).split(b":")[1]), None
                    yield parse(h.get("WARC-Source-Row")), h.get("WARC-Target-URI"), h["WARC-Date"], size, digest, kind, parse(h.get("WARC-Refers-To-Source-Row")), payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(parsed(batches), arrow, lambda row: len(row[7] or b"") + 300)

    return spark.read.options(**_BETWEEN, recursiveFileLookup="true").text(path).select(F.col("value").cast("binary")).mapInArrow(run, schema)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives and reads them back: a row for each record. Without ``path`` they go when the driver ends."""
    path = path or temporary(pages.sparkSession, shared_dir(pages.sparkSession))
    write_archives(pages, path, id_col, url_col, payload_col, least_bytes)
    return read_archives(pages.sparkSession, path, pages.schema[id_col].dataType).withColumnRenamed("id", id_col)
