"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response row is (record_id, target_uri, date, headers, payload); `responses` makes such rows from
crawled pages, `read_warc` from WARC files. `derive` yields two records for each response, both with
WARC-Refers-To (the response's id), its target URI and date. The metadata record lists the source's
HTTP headers, payload digest, title, language and links as warc-fields; the conversion record is the
page's text. Ids are name-based on what they refer to, so a rerun writes the same records.

Each response is handled alone: no shuffle, and memory bounded by an Arrow batch.

Pages are scanned in time that grows with their length, whatever they hold, so very long ones are
taken whole. A `<` after a page's last `>` opens no tag and is text.

Defined cases: a null payload is empty and gives an empty conversion; a null URI is left out of the
headers. Records of a WARC file with a bad length are passed over, and so are damaged gzip members (`damaged` lists
them); a file cut short ends with its last whole record. Repeated responses give repeated records. An empty table gives an empty result. Other input
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

VERSION = "WARC/1.1"
CRLF = b"\r\n"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
RECORD = "page_key string, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name:string,value:string>>, block string, block_digest string, payload_digest string, block_bytes long"

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"<(?:br|hr|/?(?:p|div|section|article|header|footer|nav|main|aside|ul|ol|li|dl|dt|dd|table|tr|h[1-6]|blockquote|pre|form|figure))\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_BLANK, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[\s]*")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK, _HREF = re.compile(r"<a\b[^>]*>", re.I), re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
#: Stands for a `<` that opens nothing. Lone surrogates occur in no valid text.
_BARE = "\udfff"
#: Response rows of a WARC file that are handed on at once.
PART = 100


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _closed(page: str) -> str:
    """The page with each `<` after its last `>` masked, but those of comments.

    Every tag that a pattern starts on then has its end, so no text is scanned twice for one.
    """
    at = page.rfind(">") + 1
    return page[:at] + page[at:].replace("<", _BARE).replace(f"{_BARE}!--", "<!--")


def plain_text(page: str) -> str:
    """Text of a page: no markup, scripts or title; blocks on lines of their own; entities resolved."""
    text = page
    for pattern, by in ((_DROP, ""), (_BREAK, "\n"), (_TAG, "")):
        text = pattern.sub(by, _closed(text))
    return _LINES.sub("\n", _BLANK.sub(" ", html.unescape(text.replace(_BARE, "<")))).strip()


def title_of(page: str) -> str | None:
    page = _closed(page)
    if (start := _TITLE.search(page)) and (end := _TITLE_END.search(page, start.end())):
        return html.unescape(page[start.end() : end.start()])
    return None


def language_of(page: str) -> str | None:
    """The last lang of the first html tag that has one."""
    return next((found[-1] for tag in _HTML.finditer(_closed(page)) if (found := _LANG.findall(tag[0]))), None)


def links_of(page: str) -> Iterator[str]:
    page, at = _closed(page), 0
    while tag := _LINK.search(page, at):
        at = tag.end()
        if (name := _HREF.search(page, tag.start(), at)) and (value := _VALUE.match(page, name.end())):
            at = max(at, value.end())
            yield html.unescape(value[1] or value[2] or value[3] or "")


def _one_line(value: str) -> str:
    return " ".join(value.split())


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as bytes; header values are kept to a line."""
    head = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + CRLF * 2


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        if not line:
            return  # cut short within its headers
        size = headers.get("Content-Length", "0")
        if not (size.isascii() and size.isdigit()):
            continue
        block = stream.read(int(size))
        if len(block) < int(size):
            return
        yield headers, block


MAGIC = b"\x1f\x8b\x08"


class _Member(io.RawIOBase):
    """The bytes of the gzip member at `start`, inflated as they are read; `end` is where it stops, once known."""

    def __init__(self, data: memoryview, start: int) -> None:
        self.data, self.at, self.end, self.inflate = data, start, None, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while self.end is None:
            held = self.inflate.unconsumed_tail or self.data[self.at : self.at + 65536]
            if not len(held):
                return 0  # cut short
            self.at += 0 if self.inflate.unconsumed_tail else len(held)
            got = self.inflate.decompress(held, len(out))
            if self.inflate.eof:
                self.end = self.at - len(self.inflate.unused_data)
            if got:
                out[: len(got)] = got
                return len(got)
        return 0


def _verified(data: memoryview, start: int) -> tuple[int | None, str | None]:
    """End of the member at `start` and what is wrong with it, checksum included; the end is None where there is none."""
    member = _Member(data, start)
    try:
        while member.read(1 << 20):
            pass
    except (zlib.error, OSError) as e:
        return None, str(e)
    return member.end, None if member.end is not None else "cut short"


def members(data: bytes) -> Iterator[tuple[int, str | None, Iterator[tuple[dict[str, str], bytes]]]]:
    """(offset, problem, records) of each gzip member of a WARC file; one member without compression.

    A member is inflated once to check it and once for its records, a record at a time. A damaged one gives no
    records, and reading goes on at the next member that inflates to a record; one that the file's end cuts
    short gives its whole records.
    """
    if data[:2] != MAGIC[:2]:
        yield 0, None, _records(io.BytesIO(data))
        return
    view, at = memoryview(data), 0

    def next_sound(at: int) -> int:
        """Where the next member begins that inflates to the start of a record; -1 without one."""
        while (at := data.find(MAGIC, at)) >= 0:
            try:
                if _Member(view, at).read(5) == b"WARC/":
                    return at
            except (zlib.error, OSError):
                pass
            at += 1
        return -1

    while (start := at if data[at : at + 3] == MAGIC else next_sound(at)) >= 0:
        end, problem = _verified(view, start)
        at = end if end is not None else start + 1
        if problem == "cut short" and next_sound(at) < 0:
            yield start, problem, _records(io.BufferedReader(_Member(view, start)))
            return
        if problem:
            yield start, problem, iter(())
        elif end is not None:
            yield start, None, _records(io.BufferedReader(_Member(view, start)))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each whole record of a WARC file's bytes, gzipped or not, a record at a time."""
    for _, _, records in members(data):
        yield from records


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decoded(body: bytes, content_type: str) -> str:
    """A body as text: by the charset of its Content-Type, else of its first kilobyte, else as UTF-8."""
    named = _CHARSET.search(content_type.encode()) or _CHARSET.search(body[:1024])
    try:
        return body.decode(named[1].decode("ascii", "replace") if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response rows."""
    name = F.sha1(F.concat_ws("\n", F.lit("response"), F.col("page_id").cast("string"), "url"))
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    return pages.select(
        F.col("page_id").cast("string").alias("page_key"),
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-8$4-$5"), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.array(head("Content-Type", F.lit("text/html; charset=utf-8")), head("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))))).alias("headers"),
        F.col("html").alias("payload"),
    )


def _warc_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def damaged(spark, path: str) -> DataFrame:
    """file, offset, problem of the gzip members of WARC files that were passed over or end too soon."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(f, at, why) for f, content in zip(b["path"], b["content"], strict=True) for at, why, _ in members(bytes(content)) if why]
            yield pd.DataFrame(rows, columns=["file", "offset", "problem"])

    return _warc_files(spark, path).mapInPandas(run, "file string, offset long, problem string")


def read_warc(spark, path: str) -> DataFrame:
    """Response rows of the WARC files at path (through Spark's reader, so any store; a file of up to 2 GB is one row).

    payload_digest is that of the bytes as they are; the text is decoded by their charset.
    """
    schema = "page_key string, record_id string, target_uri string, date string, headers array<struct<name:string,value:string>>, payload string, payload_digest string"

    def run(batches):
        import pandas as pd

        names = ["page_key", "record_id", "target_uri", "date", "headers", "payload", "payload_digest"]
        for b in batches:
            for content in b["content"]:
                rows = []
                for h, block in parse(bytes(content)):
                    if h.get("WARC-Type") != "response":
                        continue
                    top, _, body = block.partition(b"\r\n\r\n")
                    pairs = [tuple(map(str.strip, x.split(":", 1))) for x in top.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x]
                    kind = next((v for n, v in pairs if n.lower() == "content-type"), "")
                    pairs += [(n, h[n]) for n in ("WARC-Payload-Digest",) if n in h]
                    if len(rows) == PART:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                    rows.append((h.get("WARC-Record-ID"), h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), h.get("WARC-Date"), [{"name": n, "value": v} for n, v in pairs], decoded(body, kind), digest(body)))
                yield pd.DataFrame(rows, columns=names)

    return _warc_files(spark, path).select("content").mapInPandas(run, schema)


def _derived(key, rid, uri, date, headers, payload, stated=None) -> list[tuple]:
    page, uri_headers = payload or "", [("WARC-Target-URI", uri)] * (uri is not None)
    source = stated or digest(page.encode())
    title, lang = title_of(page), language_of(page)
    fields = [(f"source-header-{x['name']}", x["value"] or "") for x in headers or ()] + [("source-payload-digest", source)]
    fields += [("title", title)] if title is not None else []
    fields += [("language", lang)] if lang else []
    fields += [("outlink", x) for x in links_of(page)]
    metadata = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in fields)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        own, data = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {rid}')}>", block.encode()
        d = digest(data)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date or ""), *uri_headers, ("WARC-Refers-To", rid or "")]
        head += [("WARC-Refers-To-Target-URI", uri)] * (uri is not None) + [("WARC-Refers-To-Date", date or ""), ("Content-Type", content_type), ("WARC-Block-Digest", d)]
        out.append((key, kind, own, rid, uri, date, content_type, [{"name": n, "value": v} for n, v in head], block, d, source, len(data)))
    return out


def derive(found: DataFrame) -> DataFrame:
    """Metadata and conversion records (schema RECORD) of response rows.

    payload_digest, where found has it, is the digest of the payload's bytes; else it is taken of the text in UTF-8.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [("page_key", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
                 ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("block_bytes", pa.int64())]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in _derived(*x)]
                yield pa.record_batch([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    stated = F.col("payload_digest") if "payload_digest" in found.columns else F.lit(None).cast("string").alias("payload_digest")
    return found.select("page_key", "record_id", "target_uri", "date", "headers", "payload", stated).mapInArrow(run, RECORD)


def with_bytes(records: DataFrame) -> DataFrame:
    """Adds `record`: the gzip member of each record, so that concatenated members are a WARC file."""

    @F.pandas_udf("binary")
    def member(headers, block):
        import pandas as pd

        return pd.Series([gzip.compress(serialise([(x["name"], x["value"]) for x in h], t.encode()), mtime=0) for h, t in zip(headers, block, strict=True)])

    return records.withColumn("record", member("headers", "block"))


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    out = derive(responses(read_table(spark, sf_dir, "pages")))
    return out.select(F.col("page_key").cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.to_json("headers").alias("headers"), "block", "block_bytes", "block_digest", "payload_digest")
