"""WARC derivatives: a metadata record and a plain-text conversion record for every response.

A response is a WARC 1.1 record whose block is an HTTP message. From each, two records are derived, both of which
refer to it by its identifier (WARC-Refers-To), carry its target URI and date, and repeat its payload digest in
WARC-Source-Payload-Digest and its HTTP headers (in the metadata record's block, as one JSON object together with the title
and the links). Each derived record has its own identifier, made from the response's and the kind, so reruns agree,
and digests of its own block. Digests are sha1 in base 32.

Parsing is per row in Arrow batches; nothing is shuffled. ``write_warc`` writes one WARC file per partition.

A response's identifier is made from page_id, url and payload digest, so pages that differ in any have identifiers of their own.

Defined cases: a null or empty page is a response with an empty body, whose conversion has an empty block; a null url gives an empty
target URI; a block without a header end is all header; rows that repeat in full are the same response and derive equal records each; markup that
the parser gives up on is read as text, and a charset that doesn't exist or doesn't decode texts as UTF-8; very long pages are read whole; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
RECORD = "page_id long, record_id string, warc_type string, headers array<struct<name:string,value:string>>, block binary"
DERIVED = "page_id long, record_id string, warc_type string, refers_to string, target_uri string, source_payload_digest string, block_digest string, headers array<struct<name:string,value:string>>, block binary"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
#: Elements whose content isn't text, and elements that end a line.
SILENT = {"script", "style", "noscript", "template"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "pre", "blockquote", "title"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


class Page(HTMLParser):
    """Text, title and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.silent = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT
        self.in_title = self.in_title or tag == "title"
        if tag in BREAKS:
            self.parts.append("\n")
        self.links += [v for k, v in attrs if v and (tag, k) in (("a", "href"), ("img", "src"), ("link", "href"))]

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in SILENT))
        self.in_title = self.in_title and tag != "title"
        if tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def read_page(body: str) -> Page:
    """The page's parts; of a body that the parser gives up on, with its marked sections and declarations read as text, or else without its tags."""
    for source in (body, body.replace("<!", "&lt;!"), re.sub(r"<[^<>]*>?", "\n", body)):
        page = Page()
        try:
            page.feed(source)
            page.close()
        except (AssertionError, ValueError, RecursionError):
            continue
        return page
    page = Page()
    page.parts = [body]
    return page


def read_text(body: bytes, http: list[tuple[str, str]]) -> str:
    """The body in the charset that the headers name; in UTF-8 if they name none, or none that decodes texts. Bad bytes are replaced."""
    named = next((m[1] for n, v in http if n.lower() == "content-type" and (m := re.search(r"""charset\s*=\s*["']?([\w.:+-]+)""", v, re.I))), "utf-8")
    try:
        return body.decode(named, "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)]
    return status, headers, body


def _header_lists(column: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [x for row in column for x in row]
    pairs = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], fields=list(_HEADERS.value_type))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, column))], pa.int32()), pairs)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<.*>", "", schema))
    kinds = {"page_id": pa.int64(), "block": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.record_batch([_header_lists(c) if k == "headers" else pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names, columns, strict=True)], names=names)


def _header_rows(column: pa.Array) -> list[list[tuple[str, str]]]:
    """The headers of each row, without a dictionary for each."""
    names, values = column.flatten().flatten()
    pairs = list(zip(names.to_pylist(), values.to_pylist(), strict=True))
    ends = [0, *accumulate(column.value_lengths().fill_null(0).to_pylist())]
    return [pairs[i:j] for i, j in pairwise(ends)]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for every row of page_id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = html.encode()
                payload = digest(body)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rid = identifier("response", page_id, url, payload)
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
                rows.append((page_id, rid, "response", headers, block))
            yield _batch(rows, RECORD)

    empty = F.lit("")
    return pages.select(F.col("page_id").cast("long"), F.coalesce("url", empty), F.coalesce("html", empty)).mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response among the records."""

    def two(page_id: int | None, rid: str, headers: list[tuple[str, str]], block: bytes) -> list[tuple]:
        own = {n.lower(): v for n, v in headers}
        status, http, body = split_http(block)
        page = read_page(read_text(body, http))
        # what stands for half a pair can't be written
        clean = lambda x: x.encode("utf-8", "replace").decode()
        uri, date, payload = own.get("warc-target-uri", ""), own.get("warc-date", ""), own.get("warc-payload-digest") or digest(body)
        told = {"status": status, "headers": [list(x) for x in http], "title": " ".join("".join(page.title).split()), "links": page.links}
        out = []
        source = [("WARC-Source-HTTP-Header", f"{n}: {v}") for n, v in http]
        for kind, mime, data in (("metadata", "application/json", clean(json.dumps(told, ensure_ascii=False)).encode()), ("conversion", "text/plain", clean(page.text()).encode())):
            new, own_digest = identifier(kind, rid), digest(data)
            fields = [("WARC-Type", kind), ("WARC-Record-ID", new), ("WARC-Refers-To", rid), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Source-Payload-Digest", payload), *source, ("Content-Type", mime), ("WARC-Block-Digest", own_digest), ("Content-Length", str(len(data)))]
            out.append((page_id, new, kind, rid, uri, payload, own_digest, fields, data))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, rid, headers, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _header_rows(b.column(2)), b.column(3).to_pylist(), strict=True):
                rows += two(page_id, rid, headers, block)
            yield _batch(rows, DERIVED)

    return records.where("warc_type = 'response'").select("page_id", "record_id", "headers", "block").mapInArrow(run, DERIVED)


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file per partition, through Spark's own writer, of records whose blocks are UTF-8."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")
    whole = F.concat(F.lit(f"{VERSION}\r\n"), lines, F.lit("\r\n\r\n"), F.decode("block", "UTF-8"), F.lit("\r\n"))
    records.select(whole.alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def read_warc(data: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of a WARC file."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])]
        size = int(next(v for n, v in headers if n.lower() == "content-length"))
        found.append((headers, data[end + 4 : end + 4 + size]))
        at = end + 4 + size + 4
    return found


def load_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under path, plain or gzip, one member per record or in all; page_id is null.

    A file is read by one task, as Spark's source of whole files does it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                found = read_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                rows = []
                for headers, block in found:
                    own = {n.lower(): v for n, v in headers}
                    rows.append((None, own.get("warc-record-id"), own.get("warc-type"), headers, block))
                yield _batch(rows, RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def derivative_digests(pages: DataFrame) -> DataFrame:
    """One row per derived record, with the size and the sha256 of its block in place of the block."""
    records = derive(responses(pages))
    return records.select("page_id", "record_id", "warc_type", "refers_to", "target_uri", "source_payload_digest", "block_digest", F.size("headers").cast("long").alias("n_headers"), F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))
