"""Metadata and conversion records from WARC responses (operator 4).

Each response gives a ``metadata`` record with its HTTP headers, title and links,
and a ``conversion`` record with its plain text. Both keep the target and date,
refer to the response's record id, and carry its payload digest. Ids and digests
depend on the content alone, so a repeated task writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billforge.llm.text import slices

_FIELDS = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_payload_digest string, block binary, page_id long, concurrent_to string"
_KINDS = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())

_HIDDEN = ("script", "style", "noscript", "template")
_BREAK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav title blockquote pre hr".split())
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9]*)")
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in (*_HIDDEN, "title")}
_HREF = re.compile(r"\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)
_CONTROL = re.compile(r"[\x00-\x20\x7f]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def scan(page: str) -> tuple[str | None, list[str], str]:
    """Title (None without one), link targets in order and visible text with line breaks, all with their entities.

    One pass from tag to tag; what is searched for once and not found is not
    searched for again, so the time grows with the page whatever its openings.
    Comments and hidden elements give a space, block elements a line break; one
    that is never closed counts as its opening tag alone, a ``<`` without ``>`` as text.
    """
    out: list[str] = []
    links: list[str] = []
    title = None
    absent: set[str] = set()

    def end_of(name: str, start: int) -> tuple[int, int] | None:
        if name in absent:
            return None
        if name == "-->":
            i = page.find("-->", start)
            found = (i, i + 3) if i >= 0 else None
        else:
            m = _CLOSE[name].search(page, start)
            found = m.span() if m else None
        if found is None:
            absent.add(name)
        return found

    at, size, close = 0, len(page), 0
    while at < size:
        i = page.find("<", at)
        if i < 0:
            break
        out.append(page[at:i])
        if page.startswith("<!--", i) and (end := end_of("-->", i + 4)):
            out.append(" ")
            at = end[1]
            continue
        close = close if close > i else page.find(">", i)  # the next one, looked for once
        if close < 0:
            at = i
            break
        if not (page[i + 1] in "/!" or (page[i + 1].isascii() and page[i + 1].isalpha())):
            out.append("<")
            at = i + 1
            continue
        m = _NAME.match(page, i + 1, close)
        name = m[1].lower() if m else ""
        at = close + 1
        if page[i + 1] == "/":
            pass
        elif name in _HIDDEN:
            if end := end_of(name, at):
                out.append(" ")
                at = end[1]
        elif name == "title" and title is None:
            if end := end_of(name, at):
                title = page[at : end[0]]
        elif name == "a" and (href := _HREF.search(page, i, close)):
            links.append(href[1])
        if name in _BREAK:
            out.append("\n")
    out.append(page[at:])
    return title, links, "".join(out)


def plain_text(visible: str) -> str:
    """Visible text of scan: entities resolved, blank lines left out, white space single."""
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in visible.split("\n")) if x)


def one_line(value: str) -> str:
    """A field's value with its entities resolved; control characters and white space become single spaces, so no field can start inside it."""
    return " ".join(_CONTROL.sub(" ", html.unescape(value)).split())


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and payload; a block without a header end is all payload.

    A line that starts with white space continues the header before it; a line
    without a colon is no header and is left out.
    """
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, list[str]]] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t"):
            if headers:
                headers[-1][1].append(line.strip())
        elif colon:
            headers.append((name.strip(), [value.strip()]))
    return status, [(name, " ".join(values)) for name, values in headers], payload


def derivatives(record: dict) -> list[tuple]:
    """The two derived records of one response (record_id, target_uri, warc_date, block, page_id), which name each other."""
    status, headers, payload = split_http(record["block"] or b"")
    page = payload.decode("utf-8", "replace")
    source = digest(payload)
    title, links, visible = scan(page)
    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", source)]
    if title is not None:
        fields.append(("title", title))
    fields += [("outlink", x) for x in links]
    metadata = "".join(f"{one_line(k)}: {one_line(v) if k in ('title', 'outlink') else _CONTROL.sub(' ', v)}\r\n" for k, v in fields).encode()
    text = plain_text(visible).encode()
    refers = record["record_id"]
    ids = {kind: record_id(kind, refers or "", source) for kind in ("metadata", "conversion")}
    out = []
    for kind, other, media, block in (("metadata", "conversion", "application/warc-fields", metadata), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        out.append((kind, ids[kind], refers, record["target_uri"], record["warc_date"], media, len(block), digest(block), source, block, record["page_id"], ids[other]))
    return out


def responses(pages: DataFrame) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): record_id, target_uri, warc_date, block, page_id.

    A null html is an empty payload, a null url a null target.
    """
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.md5(F.concat_ws("\0", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.md5(body.cast("binary"))).cast("binary"))
    dashed = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(head, body).cast("binary").alias("block"),
        F.col("page_id").cast("long").alias("page_id"),
    )


def build(records: DataFrame) -> DataFrame:
    """Derived records of response ``records``, two for each row; equal rows give equal records, an empty table none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [d for r in part.to_pylist() for d in derivatives(r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return records.select("record_id", "target_uri", "warc_date", "block", "page_id").mapInArrow(run, _FIELDS)


def serialized(records: DataFrame) -> DataFrame:
    """``records`` with ``record``: the bytes of each as it stands in a WARC 1.1 file; absent fields are left out.

    WARC allows no concurrent id on conversion records, so only the metadata names the other.
    """
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in names]
    lines.append(F.when(F.col("record_type") == "metadata", F.concat(F.lit("WARC-Concurrent-To: "), F.col("concurrent_to"))))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.lit(""), F.lit(""))
    return records.withColumn("record", F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary")))
