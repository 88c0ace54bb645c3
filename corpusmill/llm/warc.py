"""WARC records: responses from pages, metadata and plain-text conversion records derived from them, files of records.

A record is a row ``headers`` (array of ``name, value``, in order, repeats allowed) and ``content`` (the block).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from corpusmill.llm import hashing as H

Headers = list[tuple[str, str]]
_HEADERS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))
RECORD = StructType([StructField("headers", _HEADERS), StructField("content", BinaryType())])
_ARROW = pa.schema([("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("content", pa.binary())])
_BATCH = 8 << 20
VERSION = b"WARC/1.1\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier, so a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def value_of(headers: Headers, name: str) -> str | None:
    """The first value of a header; names have no case."""
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def response_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One ``response`` record per row of ``pages(page_id, url, html)``.

    A null ``html`` is an empty payload; a null ``url`` gives no target. Repeated rows give records of one identifier,
    which is made of ``page_id``, ``url`` and the digest of the page. Other columns are not read.
    """

    def respond(row: dict) -> Iterator[tuple[Headers, bytes]]:
        body, url = (row["html"] or "").encode(), row["url"]
        content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        payload = digest(body)
        yield (
            [
                ("WARC-Type", "response"),
                ("WARC-Record-ID", record_id("response", str(row["page_id"]), url or "", payload)),
                *([("WARC-Target-URI", _one_line(url))] if url is not None else []),
                ("WARC-Date", date),
                ("Content-Type", "application/http; msgtype=response"),
                ("WARC-Payload-Digest", payload),
                ("WARC-Block-Digest", digest(content)),
                ("Content-Length", str(len(content))),
            ],
            content,
        )

    return _mapped(pages.select("page_id", "url", "html"), respond)


def derived_records(records: DataFrame) -> DataFrame:
    """For each ``response`` record a ``metadata`` and a ``conversion`` record that refer to it; other records give none.

    The metadata block has the source's WARC headers (``source-``), HTTP status line and headers (``http-``), the
    digest of its payload as found, title and links. The conversion block is the page as plain text. Both carry the
    source's target, date and identifier (``WARC-Refers-To`` with target and date). A block without an HTTP header
    is taken as payload as a whole; null headers or content count as empty. Bytes that are not UTF-8 are read in the
    charset of the HTTP header, or with replacement characters.
    """

    def derive(row: dict) -> Iterator[tuple[Headers, bytes]]:
        source = [(h["name"] or "", h["value"] or "") for h in row["headers"] or [] if h is not None]
        if (value_of(source, "WARC-Type") or "").lower() != "response":
            return
        status, http, payload = http_parts(row["content"] or b"")
        page, sourced = decoded(payload, http), value_of(source, "WARC-Payload-Digest")
        origin = value_of(source, "WARC-Record-ID") or record_id("unnamed", digest(row["content"] or b""))
        fields = [(f"source-{n.lower()}", v) for n, v in source]
        fields += [("http-status", status)] if status else []
        fields += [(f"http-{n.lower()}", v) for n, v in http]
        fields += [("payload-digest", digest(payload)), ("payload-digest-match", str(sourced is None or sourced == digest(payload)).lower())]
        fields += [("title", t) for t in titles(page)] + [("outlink", link) for link in links(page)]
        metadata = b"".join(f"{n}: {_one_line(v)}\r\n".encode() for n, v in fields)
        for kind, mime, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
            target, date = value_of(source, "WARC-Target-URI"), value_of(source, "WARC-Date")
            yield (
                [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", record_id(kind, origin)),
                    ("WARC-Refers-To", origin),
                    *([("WARC-Refers-To-Target-URI", target), ("WARC-Target-URI", target)] if target is not None else []),
                    *([("WARC-Refers-To-Date", date), ("WARC-Date", date)] if date is not None else []),
                    ("WARC-Source-Payload-Digest", sourced or digest(payload)),
                    ("Content-Type", mime),
                    ("WARC-Block-Digest", digest(block)),
                    ("Content-Length", str(len(block))),
                ],
                block,
            )

    return _mapped(records.select("headers", "content"), derive)


def _mapped(rows: DataFrame, make: Callable[[dict], Iterator[tuple[Headers, bytes]]]) -> DataFrame:
    H.bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[Headers, bytes]] = []
            size = 0
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                for record in make(row):
                    held.append(record)
                    size += len(record[1])
                if size > _BATCH:
                    yield _packed(held)
                    held, size = [], 0
            yield _packed(held)

    return rows.mapInArrow(run, RECORD)


def _packed(records: list[tuple[Headers, bytes]]) -> pa.RecordBatch:
    headers = [[{"name": n, "value": v} for n, v in h] for h, _ in records]
    return pa.RecordBatch.from_arrays([pa.array(headers, _ARROW.field(0).type), pa.array([c for _, c in records], pa.binary())], schema=_ARROW)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def http_parts(content: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload; continued header lines are joined."""
    if not content.startswith(b"HTTP/") or (end := re.search(rb"\r?\n\r?\n", content)) is None:
        return "", [], content
    lines = re.sub(r"\r?\n[ \t]+", " ", content[: end.start()].decode("utf-8", "replace")).splitlines()
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return lines[0], [(n.strip(), v.strip()) for n, _, v in pairs], content[end.end() :]


def decoded(payload: bytes, http: Headers) -> str:
    try:
        return payload.decode()
    except UnicodeDecodeError:
        named = re.search(r"charset=[\"']?([\w.:-]+)", value_of(http, "Content-Type") or "", re.I)
        try:
            return payload.decode(named[1] if named else "utf-8", "replace")
        except LookupError:
            return payload.decode("utf-8", "replace")


# a tag that nothing closes reaches to the end of the page, so that no byte is searched once per tag before it
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.I | re.S)
_BLOCK = re.compile(r"<(/?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul))\b[^>]*+(?:>|\Z)", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*+>?")
_TITLE = re.compile(r"<title\b[^>]*+(?:>(.*?)(?:</title\s*>|\Z)|\Z)", re.I | re.S)
_ANCHOR = re.compile(r"<a(?=\s)", re.I)
_QUOTED_TAG = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"([^>]*+)>?")
_HREF = re.compile(r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def plain_text(page: str) -> str:
    """All text that a page shows, a line per block; white space inside a line becomes one space."""
    text = _TAG.sub("", _BLOCK.sub("\n", re.sub(r"\s+", " ", _UNSEEN.sub(" ", page))))
    return "\n".join(line for part in text.split("\n") if (line := " ".join(entities.unescape(part).split())))


def titles(page: str) -> list[str]:
    found = _TITLE.search(page)
    return [" ".join(entities.unescape(found[1]).split())] if found and found[1] is not None else []


def links(page: str) -> list[str]:
    """Targets of anchors, in order, each once; those in comments and scripts too.

    A ``>`` in quotes does not end a tag. Where that leaves a tag open to the end of the page, quotes count no more
    from there on, and a tag ends at the next ``>``, or else with the page.
    """
    found: dict[str, None] = {}
    at, quoted = 0, True
    while m := _ANCHOR.search(page, at):
        tag = _QUOTED_TAG.match(page, m.end()) if quoted else None
        if tag is None:
            quoted, tag = False, _PLAIN_TAG.match(page, m.end())
        at = tag.end()
        if target := _HREF.search(tag[1]):
            found[entities.unescape("".join(v or "" for v in target.groups()))] = None
    return list(found)


def serialized(records: DataFrame) -> DataFrame:
    """``record``: version line, headers, an empty line and the block, as bytes."""
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n")))
    head = F.concat(F.lit(VERSION.decode()), F.array_join(lines, ""), F.lit("\r\n"))
    return records.select(F.concat(head.cast("binary"), F.coalesce("content", F.lit(b""))).alias("record"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """WARC files, gzipped; two line ends follow each record. Spark's committer makes repeated tasks harmless."""
    rows = serialized(records).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files below ``path`` whatever their names, gzipped or not.

    A file is read by one task, which holds it as stored and unpacks its records one after the other.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("content"):
                held: list[tuple[Headers, bytes]] = []
                size = 0
                for record in records_in(value.as_py()):
                    held.append(record)
                    size += len(record[1])
                    if size > _BATCH or len(held) >= 500:
                        yield _packed(held)
                        held, size = [], 0
                yield _packed(held)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(read, RECORD)


def records_in(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a file; blocks are as long as their Content-Length says.

    Lines before a version line are skipped. A record that the file cuts off is given as far as it goes.
    """
    stored = io.BytesIO(data)
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stored)) if data[:2] == b"\x1f\x8b" else stored
    while line := lines.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = iter(lambda: lines.readline().decode("utf-8", "replace").strip(), "")
        headers = [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in head)]
        yield headers, lines.read(int(value_of(headers, "Content-Length") or 0))
