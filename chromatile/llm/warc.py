"""Legacy archives (ARC 1 and 2) converted to WARC 1.1.

``write_arc`` makes legacy archives from pages, ``read_arc`` parses them by their version-specific
header lines and declared lengths, ``convert`` synthesises the equivalent WARC records (identifiers,
timestamps, types, digests) and writes them, and ``read_warc`` reads WARC archives by declared
lengths. All files go through Spark's readers and writers, so they lie where Spark's paths point.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialise, new_path

# Fixed values of the ARC formats: field lines of version 1 and 2.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
RECORD_END = "\r\n\r\n"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _text(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _strings(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.string()).view(pa.binary()).to_pylist()


# ---- ARC ----


def _arc_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 chromatile\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = ["0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return f"filedesc://{name} {' '.join(rest)} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20260101000000", chunk_bytes: int = 8 << 20) -> None:
    """Write ``pages`` as gzipped ARC archives of about ``chunk_bytes`` (a larger page makes a larger one).

    Versions 1 and 2 take turns. The network document of a page is an HTTP response whose headers
    hold the id (``X-Page-Id``, absent for null) and whose body is the html in UTF-8 (null: empty).
    White space and control characters of a URL are percent-encoded; a null URL becomes about:blank.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_text([b"".join(parts)])], ["value"])

        for batch in batches:
            for key, url, html in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), _strings(batch.column(2)), strict=True):
                version = number % 2 + 1
                if not parts:
                    parts.append(_arc_block(version, f"chunk-{number}.arc", date))
                    size = len(parts[0])
                html = html or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if key is None else b"X-Page-Id: %d\r\n" % key) + b"Content-Length: %d\r\n\r\n" % len(html)
                url = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url if url else b"about:blank")
                fields = [url, b"0.0.0.0", date.encode(), b"text/html"] + ([b"200", b"-", b"-", b"%d" % (size + 1), b"chunk-%d.arc" % number] if version == 2 else [])
                parts += [b"\n", b" ".join(fields), b" %d\n" % (len(head) + len(html)), head, html]
                size += sum(map(len, parts[-5:]))
                if size >= chunk_bytes:
                    yield done()
                    number, parts = number + 1, []
        if parts:
            yield done()

    values = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(chunks, "value string")
    values.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def unzipped(data: bytes) -> bytes:
    """All gzip members of ``data``; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """(offset, header fields, network document) of each record of an archive.

    A version block (``filedesc://``) names the version and the fields of the records after it; it is given
    as a record of its own, with the field ``Version``.
    Fields are taken from the right, so that a stray space in a URL does no harm. A record whose
    declared length goes beyond the end raises ValueError.
    """
    at, names = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r")
        length = int(line.rsplit(b" ", 1)[1])
        if end + 1 + length > len(data):
            raise ValueError(f"record at {at} is cut off")
        body = data[end + 1 : end + 1 + length]
        if line.startswith(b"filedesc://"):
            version, named = body.split(b"\n")[:2]
            names = named.decode().split() or ARC_FIELDS[int(version.split()[0])]
            yield at, dict(zip(ARC_FIELDS[1], line.split(b" "), strict=False)) | {"Version": version}, body
        else:
            values = line.rsplit(b" ", len(names) - 1)
            yield at, dict(zip(names, values, strict=True)), body
        at = end + 1 + length


def _http(document: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and body."""
    if not document.startswith(b"HTTP/"):
        return b"", document
    found = re.search(rb"\r?\n\r?\n", document)
    return (document[: found.end()], document[found.end() :]) if found else (document, b"")


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id:\s*(-?\d+)", head)
    return int(found[1]) if found else None


_ARC_ROW = "row string, kind string, page_id long, url string, ip string, date string, content_type string, head string, payload_bytes long, payload_digest string, head_digest string, block_digest string"


#: Names of archives; others in a folder are left alone.
ARCHIVES = "*.{gz,arc,warc}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", ARCHIVES).load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives under ``path``; ``row`` (file and offset) is its name.

    Its ``kind`` is ``warcinfo`` for a version block, whose payload says what archive it was, ``response``
    for an HTTP document, else ``resource``.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[1]
                out: list[list] = [[] for _ in range(12 + with_payload)]
                for offset, fields, body in arc_records(unzipped(batch.column(1)[i].as_py())):
                    version = fields.get("Version")
                    if version is not None:
                        body = b"software: chromatile\r\nformat: WARC File Format 1.1\r\nisPartOf: %s\r\ndescription: from an ARC archive, version block %s\r\n" % (name.encode(), version)
                    head, payload = (b"", body) if version is not None else _http(body)
                    kind = b"warcinfo" if version is not None else b"response" if head else b"resource"
                    row = [f"{name}:{offset}".encode(), kind, _page_id(head), fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], head, len(payload), base32_sha1(payload).encode(), base32_sha1(head).encode(), base32_sha1(body).encode(), payload]
                    for column, x in zip(out, row, strict=False):
                        column.append(x)
                names = [x.split()[0] for x in _ARC_ROW.split(", ")] + ["payload"] * with_payload
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if n in ("page_id", "payload_bytes") else _text(c) for n, c in zip(names, out, strict=True)], names)

    return _files(spark, path).mapInArrow(parse, _ARC_ROW + ", payload string" * with_payload)


# ---- WARC ----


def _uuid(of: Column) -> Column:
    h = F.sha1(of)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _urn(row: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(row), F.lit(">"))


def _in_chunks(values: DataFrame, chunk_bytes: int) -> DataFrame:
    """The values joined by the end of a record, up to about ``chunk_bytes`` at once (a larger value is alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for value in _strings(batch.column(0)):
                if parts and size + len(value) > chunk_bytes:
                    yield pa.RecordBatch.from_arrays([_text([RECORD_END.encode().join(parts)])], ["value"])
                    parts, size = [], 0
                parts.append(value)
                size += len(value)
        if parts:
            yield pa.RecordBatch.from_arrays([_text([RECORD_END.encode().join(parts)])], ["value"])

    return values.mapInArrow(run, "value string")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, chunk_bytes: int = 32 << 20, broadcast_rows: int = 200_000) -> None:
    """Convert the ARC archives under ``arc_path`` to gzipped WARC archives under ``warc_path``.

    An archive holds about ``chunk_bytes`` bytes of records; a larger record makes a larger one.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page id
    (null ids first; ties by name) becomes a response, the others revisit it: they keep the HTTP
    headers and the digest of the payload, and name the response. The winners are found on slim
    rows, pre-aggregated. Up to ``broadcast_rows`` digests that repeat are broadcast, and no payload is shuffled; beyond
    that payloads are shuffled once. Documents that are no HTTP responses become resources and revisit
    nothing; a version block becomes a warcinfo record.
    """
    slim = read_arc(spark, arc_path, with_payload=False).filter((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = slim.groupBy("payload_digest").agg(F.max(F.struct("page_id", "row", "url", "date")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    first = materialise(first, "first")  # with an exchange of its own, so that a payload of many pages is split in the join
    rows = read_arc(spark, arc_path).join(F.broadcast(first) if first.count() <= broadcast_rows else first, "payload_digest", "left")
    iso = lambda d: F.date_format(F.to_timestamp(F.rpad(d, 14, "0"), "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = (F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & (F.col("row") != F.col("_first.row"))
    again = F.coalesce(again, F.lit(False))
    block = F.concat("head", F.when(again, F.lit("")).otherwise(F.col("payload")))
    info = F.col("kind") == "warcinfo"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise(F.col("kind"))),
        line("WARC-Record-ID", _urn(F.col("row"))),
        line("WARC-Date", iso(F.col("date"))),
        F.when(info, line("WARC-Filename", F.regexp_replace("url", "^filedesc://", ""))).otherwise(line("WARC-Target-URI", F.col("url"))),
        F.when(~info & (F.col("ip") != "0.0.0.0"), line("WARC-IP-Address", F.col("ip"))).otherwise(F.lit("")),
        F.when(info, F.lit("")).otherwise(line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _urn(F.col("_first.row"))),
                line("WARC-Refers-To-Target-URI", F.col("_first.url")),
                line("WARC-Refers-To-Date", iso(F.col("_first.date"))),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.when(info, "application/warc-fields").when(F.col("kind") == "response", "application/http; msgtype=response").otherwise(F.col("content_type"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    values = rows.select(F.concat(header, block).alias("value"))
    _in_chunks(values, chunk_bytes).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(warc_path)
    discard(first)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start, length = end + 4, int(headers["content-length"])
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end as declared")
        yield headers, data[start : start + length]
        at = start + length + 4


_WARC_ROW = "record_id string, record_type string, target_uri string, date string, refers string, page_id long, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per response, resource or revisit record of the archives under ``path``.

    A response's or resource's length and digest are those of the payload read; a digest that differs from the
    declared one raises ValueError. A revisit's are what its headers declare.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                out: list[list] = [[] for _ in range(8 + with_payload)]
                for h, block in warc_records(unzipped(content.as_py())):
                    if h["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    head, payload = _http(block) if h["warc-type"] != "resource" else (b"", block)
                    size, digest = len(payload), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if h["warc-type"] == "revisit":
                        found = re.search(rb"(?im)^Content-Length:\s*(\d+)", head)
                        size = int(found[1]) if found else None
                    elif base32_sha1(payload) != digest:
                        raise ValueError(f"digest of {h['warc-record-id']} differs")
                    for column, x in zip(out, [h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h["warc-date"], h.get("warc-refers-to"), _page_id(head), size, digest, payload], strict=False):
                        column.append(x)
                names = [x.split()[0] for x in _WARC_ROW.split(", ")] + ["payload"] * with_payload
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, out, strict=True)], names)

    return _files(spark, path).mapInArrow(parse, _WARC_ROW + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as legacy archives, convert them, and read the WARC archives back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is
    the empty payload. Of pages that repeat the largest id and the payload, one is the response.
    An empty table makes empty archives and an empty result.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_arc(pages, f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc", min_bytes)
    read = materialise(read_warc(spark, f"{path}/warc"), "records")  # slim rows; archives are parsed once
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    target = read.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    responses = read.filter("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    revisits = read.filter("record_type = 'revisit'").join(target, "refers", "left").select(*out, "refers_to")
    return responses.unionByName(revisits)
