"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Each response gives a metadata record (application/warc-fields) and a conversion record (text/plain). Both refer to
the response by WARC-Refers-To, keep its target address and date, carry all its source headers (repeated ones as
often as they stand there) and payload digest, and name one another by WARC-Concurrent-To; block digests are SHA-1 in
base 32. Record ids are uuid5 of the response's id, so a task that runs again writes the same records. Chunked and
compressed payloads are decoded before text is taken from them. What is no record gives a row of type "error".
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, small_batches, table

VERSION = "WARC/1.1"
EPOCH = "1970-01-01T00:00:00Z"
LINKING = re.compile(r"<(a|area|img|link|script|iframe)(?=[\s/>])[^>]*", re.I)
TARGET = re.compile(r"""(?<=[\s/])(href|src)\s*=\s*""", re.I)
VALUE = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
#: What the plain text leaves out with its contents (what is not closed: up to the page's end; <svg .../> has none), all tags (group 1: those that end a line).
DROPPED = re.compile(r"""<!--.*?(?:-->|\Z)|<svg(?=[\s/>])(?:[^<>"']|"[^"<]*"|'[^'<]*')*+(?<=/)>|<(script|style|template|noscript|title|svg)(?=[\s/>]).*?(?:</\1\s*>|\Z)""", re.I | re.S)
TAGS = re.compile(r"<(?:(/?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)(?=[\s/>]))|[a-z!/?])[^>]*>", re.I)
TITLE = re.compile(r"<title(?=[\s/>])[^<>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
#: Field order of a record; None values are left out.
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Concurrent-To", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Source-Payload-Digest", "Content-Type", "Content-Length"]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def clean(value: str) -> str:
    """A header value: line breaks would end the field, so white space collapses."""
    return " ".join(str(value).split())


def plain_text(page: str) -> str:
    """The page's text, one line for each block, without markup; white space collapses and empty lines go."""
    page = DROPPED.sub(" ", page).replace("\n", " ")
    end = page.rfind(">") + 1  # no tag ends behind it
    marked = TAGS.sub(lambda m: "\n" if m[1] else "", page[:end]) + page[end:]
    return "\n".join(line for raw in entities.unescape(marked).split("\n") if (line := " ".join(raw.split())))


def title_of(page: str) -> str:
    m = TITLE.search(page)
    return " ".join(entities.unescape(m[1]).split()) if m else ""


def links_of(page: str) -> list[tuple[str, str, str]]:
    """(target, element, attribute) of each link in the page's order: the first href or src with a value of each tag."""
    out = []
    for tag in LINKING.finditer(page):
        for name in TARGET.finditer(page, tag.end(1), tag.end()):
            if value := VALUE.match(page, name.end()):
                out.append((next(g for g in value.groups() if g is not None), tag[1].lower(), name[1].lower()))
                break
    return out


class Headers:
    """Header fields in order, repeated ones included; names are found whatever their case."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs

    def items(self) -> list[tuple[str, str]]:
        return self.pairs

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.pairs if k.lower() == name.lower()), default)

    def __getitem__(self, name: str) -> str:
        if (value := self.get(name)) is None:
            raise KeyError(name)
        return value


def fields_of(lines: list[str]) -> Headers:
    """Header lines as fields; a line that begins with white space goes on the one before."""
    pairs: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and pairs:
            pairs[-1] = (pairs[-1][0], f"{pairs[-1][1]} {line.strip()}".strip())
        elif line.strip():
            name, _, value = line.partition(":")
            pairs.append((name.strip(), value.strip()))
    return Headers(pairs)


def serialise(headers, block: bytes, compress: bool = False) -> bytes:
    """One record as bytes (with compress: one gzip member, reproducible)."""
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers.items() if v is not None)
    out = f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def opened(data: bytes) -> tuple[bytes, str]:
    """(what the gzip members of data hold, what went wrong); bytes that are not gzip pass as they are."""
    if data[:2] != b"\x1f\x8b":
        return data, ""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            return b"".join(out), f"gzip: {e}"
        if not member.eof:
            return b"".join(out), "gzip: the last member is cut off"
        data = member.unused_data
    return b"".join(out), ""


def records_of(data: bytes):
    """(headers, block, error) of each record in (optionally gzipped) WARC bytes.

    An error stands for bytes that are no whole record: reading goes on at the next line that begins one.
    """
    data, broken = opened(data)
    pos = 0
    while pos < len(data):
        if data[pos : pos + 2] == b"\r\n" or data[pos : pos + 1] == b"\n":
            pos += 1 + (data[pos : pos + 1] == b"\r")
            continue
        end, headers, error = data.find(b"\r\n\r\n", pos), None, "no WARC record"
        if data.startswith(b"WARC/", pos) and end >= 0:
            headers = fields_of(data[pos:end].decode("utf-8", "replace").split("\r\n")[1:])
            size = headers.get("Content-Length", "")
            if not re.fullmatch(r"[0-9]{1,18}", size):
                error = "no length"
            elif end + 4 + int(size) > len(data):
                error = f"{len(data) - end - 4} of {size} bytes"
            else:
                yield headers, data[end + 4 : end + 4 + int(size)], ""
                pos = end + 4 + int(size)
                continue
        following = data.find(b"\r\n\r\nWARC/", pos + 1)
        yield headers or Headers([]), b"", f"{error} at byte {pos}"
        pos = following + 4 if following >= 0 else len(data)
    if broken:
        yield Headers([]), b"", broken


def parse(data: bytes) -> list[tuple[Headers, bytes]]:
    """(headers, block) of each record in (optionally gzipped) WARC bytes; bytes that are no record raise."""
    out = []
    for headers, block, error in records_of(data):
        if error:
            raise ValueError(error)
        out.append((headers, block))
    return out


def response(url: str | None, html: str | None, key, date: str = EPOCH, again: int = 0) -> tuple[dict[str, str | None], bytes]:
    """A response record of a page: (headers, block); the block holds HTTP headers and the page's bytes. again tells equal pages apart."""
    payload = (html or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = urn("response", key, url, sha1(payload), *([again] if again else []))
    return {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": sha1(payload), "WARC-Block-Digest": sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}, block


def http_parts(block: bytes) -> tuple[str, Headers, bytes]:
    """(status line, headers, payload) of a response's block."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark:
        return "", Headers([]), block
    first, *lines = head.decode("latin-1").split("\r\n")
    return first, fields_of(lines), payload


def joined_chunks(payload: bytes) -> bytes | None:
    """The contents of a chunked payload; None if it is not one (many archives hold what was received already joined)."""
    out, pos = [], 0
    while m := CHUNK.match(payload, pos):
        size, pos = int(m[1], 16), m.end()
        if not size:
            return b"".join(out)
        if pos + size > len(payload):
            return None
        out.append(payload[pos : pos + size])
        pos += size + 2
    return None


def decoded(http: Headers, payload: bytes) -> tuple[bytes, str]:
    """(payload without transfer and content codings, what could not be decoded)."""
    codings = [c.strip().lower() for name in ("content-encoding", "transfer-encoding") for k, v in http.items() if k.lower() == name for c in v.split(",")]
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        if coding == "chunked":
            payload = payload if (whole := joined_chunks(payload)) is None else whole
        elif coding in ("gzip", "x-gzip"):
            payload, error = opened(payload)
            if error:
                return payload, error
        elif coding == "deflate":
            for bits in (15, -15):
                try:
                    payload = zlib.decompress(payload, bits)
                    break
                except zlib.error:
                    continue
        else:
            return b"", f"coding {coding}"
    return payload, ""


def derive(headers, block: bytes) -> list[tuple[dict[str, str | None], bytes]]:
    """The metadata and the conversion record of one response."""
    status, http, payload = http_parts(block)
    body, error = decoded(http, payload)
    m = re.search(r"charset=[\"']?([\w-]+)", http.get("content-type", ""), re.I)
    charset = m[1] if m else "utf-8"
    try:
        page = body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        page = body.decode("utf-8", "replace")
    source, url, date = headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers.get("WARC-Date")
    digest = headers.get("WARC-Payload-Digest") or sha1(payload)
    ids = {kind: urn(kind, source) for kind in ("metadata", "conversion")}
    text = plain_text(page).encode("utf-8", "replace")
    fields = [("title", title_of(page)), ("charset", charset), ("source-status", status), *((f"source-{k.lower()}", v) for k, v in http.items()), ("source-payload-digest", digest), ("text-length", len(text))]
    fields += [("source-not-decoded", error)] * bool(error)
    fields += [("outlink", f"{clean(target)} {element}/@{attribute}") for target, element, attribute in links_of(page)]
    metadata = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, other, body, media in (("metadata", "conversion", metadata, "application/warc-fields"), ("conversion", "metadata", text, "text/plain; charset=utf-8")):
        own = {"WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Target-URI": url, "WARC-Date": date, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": date, "WARC-Concurrent-To": ids[other], "WARC-Block-Digest": sha1(body), "WARC-Source-Payload-Digest": digest, "Content-Type": media, "Content-Length": str(len(body))}
        out.append((own, body))
    return out


def rows_of(key, data: bytes) -> list[tuple]:
    """Derivative rows of every response among the records of data, and an error row for what is none: type 'error', the message as its block, the record's own id and address where they can be read."""
    out = []
    for headers, block, error in records_of(data):
        if error or not headers.get("WARC-Type") or headers["WARC-Type"].lower() == "response" and not headers.get("WARC-Record-ID"):
            out.append((key, "error", headers.get("WARC-Record-ID"), None, headers.get("WARC-Target-URI"), headers.get("WARC-Date"), None, None, None, None, None, error or "no type or id"))
        elif headers["WARC-Type"].lower() == "response":
            out += [row(key, *d) for d in derive(headers, block)]
    return out


SCHEMA = "page_id {kind}, type string, record_id string, refers_to string, target_uri string, date string, concurrent_to string, content_type string, content_length long, block_digest string, source_payload_digest string, block string"
NAMES = ["page_id", "type", "record_id", "refers_to", "target_uri", "date", "concurrent_to", "content_type", "content_length", "block_digest", "source_payload_digest", "block"]


def row(key, headers: dict, block: bytes) -> tuple:
    return (key, headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), headers.get("WARC-Concurrent-To"), headers.get("Content-Type"), len(block), headers.get("WARC-Block-Digest"), headers.get("WARC-Source-Payload-Digest"), block.decode("utf-8", "replace"))


def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.string()] * 7, pa.int64(), *[pa.string()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 12, types)], NAMES)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = EPOCH) -> DataFrame:
    """(page_id, record binary): each page as a serialised response record, whole however long it is.

    Null urls leave the target out; null pages are empty. Rows with the same id, url and page are records of their
    own, with ids that differ by the row's place among the input's partitions. An empty table gives an empty
    result; other columns are not read.
    """
    small_batches(pages.sparkSession)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("at"))
    same = F.xxhash64("page_id", "url", "html")
    repeated = cut(rows.groupBy(same.alias("same")).agg(F.count("*").alias("n")).where("n > 1").select("same"), "repeated")

    def run(batches):
        for b in batches:
            columns = (b.column(i).to_pylist() for i in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([serialise(*response(u, h, k, date, n)) for k, u, h, n in zip(*columns)], pa.binary())], ["page_id", "record"])

    told = rows.withColumn("same", same).join(repeated.withColumn("again", F.lit(True)), "same", "left")
    told = told.select("page_id", "url", "html", F.when(F.col("again"), F.col("at") + 1).otherwise(F.lit(0)).alias("again"))
    return told.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion rows of every response in (page_id, record binary); other record types pass nothing on.

    A binary may hold several records, gzipped or not; what is no whole record gives a row of type 'error' instead of
    ending the job. Pages are read whole. The same record twice gives the same derivatives twice; null binaries
    and empty tables none. Other columns are not read.
    """
    small_batches(records.sparkSession)

    def run(batches):
        for b in batches:
            keys, blobs = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 64):
                pairs = zip(keys.slice(lo, 64).to_pylist(), blobs.slice(lo, 64).to_pylist())
                yield batch([r for k, blob in pairs for r in rows_of(k, blob or b"")], b.schema.field(0).type)

    return records.select("page_id", "record").mapInArrow(run, SCHEMA.format(kind=records.schema["page_id"].dataType.simpleString()))


def serialised(derived: DataFrame, compress: bool = True) -> DataFrame:
    """(page_id, type, record binary): derivative rows as WARC records, ready to be concatenated into files; error rows are no records."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                body = (r["block"] or "").encode("utf-8")
                values = [r["type"], r["record_id"], r["target_uri"], r["date"], r["refers_to"], r["target_uri"], r["date"], r["concurrent_to"], None, r["block_digest"], r["source_payload_digest"], r["content_type"], str(len(body))]
                out.append(serialise(dict(zip(FIELDS, values)), body, compress))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["page_id", "type", "record"])

    return derived.where("type <> 'error'").select(*NAMES).mapInArrow(run, f"page_id {derived.schema['page_id'].dataType.simpleString()}, type string, record binary")


def read_warc(spark, path: str) -> DataFrame:
    """(page_id: the file's path, record binary) of WARC files, plain or gzipped, one row a record, for derivatives().

    Files are read as a stream of records, so neither a file nor its unpacked contents is held whole; plain files are
    split among tasks. A block that itself holds a line with a record's beginning is put together again by its
    length, unless a split of a plain file falls between.
    """
    small_batches(spark)
    begin = b"\r\nWARC/"

    def run(batches):
        held, name = None, None
        for b in batches:
            out = [], []
            for path_, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                piece = piece or b""
                if held is not None and name == path_ and lacks(held):
                    held += begin + piece
                    continue
                if held is not None and held.strip():
                    out[0].append(name)
                    out[1].append(held)
                name, held = path_, piece if piece.startswith(b"WARC/") else b"WARC/" + piece if piece.strip() else b""
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["page_id", "record"])
        if held is not None and held.strip():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([held], pa.binary())], ["page_id", "record"])

    def lacks(record: bytes) -> bool:
        """The record's block is shorter than its length says."""
        end = record.find(b"\r\n\r\n")
        size = fields_of(record[:end].decode("utf-8", "replace").split("\r\n")[1:]).get("Content-Length", "") if end >= 0 else ""
        return bool(re.fullmatch(r"[0-9]{1,18}", size)) and end + 4 + int(size) > len(record)

    lines = spark.read.option("lineSep", begin.decode()).text(path)
    return lines.select(F.input_file_name().alias("page_id"), F.col("value").cast("binary").alias("record")).mapInArrow(run, "page_id string, record binary")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
