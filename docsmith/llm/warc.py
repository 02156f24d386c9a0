"""Operator 1, WARC derivative builder.

Every response record gives two records that refer to it: a metadata record, whose fields
keep the source's status, headers, digests, title and links, and a conversion record with
the page's plain text.  Both carry WARC-Refers-To with the response's id, its URI and date, and
WARC-Concurrent-To with each other's id; block digests are SHA-1 in base 32, as in
the WARC 1.1 format.  Ids are name-based UUIDs of the response's id, so a second run
gives the same records.  One pass, no shuffle.

Pages are read by one scan that never goes back, so a page takes time in proportion to its length
however broken it is: a tag ends at the first ``>`` outside a quoted value, and what a comment, a value
or a script leaves open reaches to the end of the page, as the HTML standard has it.  Payloads are freed of
chunks and of gzip, deflate and zstd first; the source digests are of the bytes as they came.

Edge cases: a response without a block, or whose header has no end, counts as headers only
and converts to an empty text; a null URI or date leaves that header out; rows without an id get one from
their URI and block; a charset that is unknown, or no charset of text, counts as UTF-8; a payload whose coding
is unknown or broken converts to what could be read of it; repeated rows give repeated records; an empty table
gives an empty table.  Columns other than the named ones are not carried over.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Elements whose end and start break a line, and elements whose content is no text.
BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())
HIDDEN = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "noscript", "template", "title", "iframe", "noembed", "noframes")}
LINKED = {"a": "href", "area": "href", "link": "href", "img": "src"}
# no part gives back what it has taken, and the end of the page closes everything: no position is read twice
MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)))?+")
#: Long references to numbers, which ``html`` would not read.
LONG_NUMBER = re.compile(r"&#([xX]?)([0-9a-fA-F]{8,}+);?")
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*+")
#: Charsets that a page may name.
CHARSETS = re.compile(r"utf-(8|16|16-le|16-be|32|32-le|32-be)|iso8859-\d+|cp\d+|ascii|koi8-[rut]|mac-\w+|gb2312|gbk|gb18030|hz|big5|big5hkscs|euc_(jp|kr|jis_2004|jisx0213)|iso2022_(jp|kr)\w*|shift_jis\w*|johab|tis-620|ptcp154")
RECORD = "record_id string, record_type string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, n_links long, headers array<struct<name:string,value:string>>, block binary"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def _short(found: re.Match) -> str:
    digits = found[2].lstrip("0")
    return f"&#{found[1]}{digits or 0};" if len(digits) < 8 else "\ufffd"


def _resolved(text: str) -> str:
    return html.unescape(LONG_NUMBER.sub(_short, text)) if "&" in text else text


def read_page(page: str) -> tuple[str, str | None, list[tuple[str, str, str]]]:
    """The text of a page (a line for each block, blanks collapsed, references resolved), its title, and its links (element, attribute, target)."""
    pieces, links, title = [], [], None
    at = 0
    while (found := MARKUP.search(page, at)) is not None:
        if found.start() > at:
            pieces.append(_resolved(page[at : found.start()]))
        at = found.end()
        if found[2] is None:
            pieces.append(" ")
            continue
        name, closing = found[2].lower(), bool(found[1])
        pieces.append("\n" if name in BLOCKS else " " if name == "img" else "")
        if closing:
            continue
        if name in LINKED and found[3]:
            wanted = LINKED[name]
            for a in ATTRIBUTE.finditer(found[3]):
                if a[1].lower() == wanted:
                    links.append((name, wanted, _resolved(a[2] or a[3] or a[4] or "").strip()))
                    break
        if name in HIDDEN:
            end = HIDDEN[name].search(page, at)
            stop = end.start() if end else len(page)
            if name == "title" and title is None:
                title = _resolved(page[at:stop])
            pieces.append(" ")
            at = stop
    if at < len(page):
        pieces.append(_resolved(page[at:]))
    return LINES.sub("\n", SPACES.sub(" ", "".join(pieces))).strip(), title, links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """The status line, header fields and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return lines[0], fields, payload


def charset_of(fields: list[tuple[str, str]], payload: bytes) -> str:
    """The charset that the header names, else the page itself near its start, if it is one of text; else UTF-8."""
    named = [m[1] for name, value in fields if name.lower() == "content-type" and (m := re.search(r"charset\s*=\s*[\"']?([\w.:+-]+)", value, re.I))]
    if not named and (m := re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:+-]{1,40})", payload[:1024], re.I)):
        named = [m[1].decode("ascii", "replace")]
    for name in named[:1]:
        try:
            found = codecs.lookup(name).name
        except (LookupError, UnicodeError, ValueError):
            break
        if CHARSETS.fullmatch(found):
            return found
    return "utf-8"


def without_chunks(body: bytes) -> bytes:
    """A chunked body in one piece; from where the chunks are broken on, as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at, at + 100)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            break
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) + body[at:]


def decoded(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without transfer and content codings; of a broken one, what could be read."""
    header = {n.lower(): v.lower() for n, v in fields}
    if "chunked" in header.get("transfer-encoding", ""):
        payload = without_chunks(payload)
    for coding in reversed([c.strip() for c in header.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip", "deflate"):
            # archives often hold bodies that are decoded already
            if coding == "deflate" or payload[:2] == b"\x1f\x8b":
                payload = _inflated(payload, 31 if coding != "deflate" else 15 if payload[:1] and payload[0] & 15 == 8 else -15)
        elif coding == "zstd" and payload[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            out = []
            try:
                for piece in zstandard.ZstdDecompressor().read_to_iter(payload):
                    out.append(piece)
            except zstandard.ZstdError:
                pass
            payload = b"".join(out)
    return payload


def _inflated(raw: bytes, window: int) -> bytes:
    out, machine = [], zlib.decompressobj(window)
    for k in range(0, len(raw), 1 << 16):
        try:
            out.append(machine.decompress(raw[k : k + (1 << 16)]))
        except zlib.error:
            return b"".join(out) if out else raw
    return b"".join(out)


def derive(record_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of a response."""
    block = block or b""
    record_id = record_id or f"<urn:uuid:{uuid.uuid5(SPACE, f'{uri}|{digest(block)}')}>"
    status, fields, payload = split_response(block)
    body = decoded(fields, payload)
    text, title, links = read_page(body.decode(charset_of(fields, body), "replace"))
    one_line = lambda x: re.sub(r"\s+", " ", x).strip()
    source = digest(payload)
    lines = [("source-status", one_line(status)), *((f"source-header-{n.lower()}", one_line(v)) for n, v in fields), ("source-block-digest", digest(block)), ("source-payload-digest", source)]
    lines += [("title", one_line(title))] if title is not None else []
    lines += [("outlink", f"{one_line(to)} {element}/@{attribute}") for element, attribute, to in links]
    blocks = {"metadata": "".join(f"{n}: {v}\r\n" for n, v in lines).encode("utf-8", "replace"), "conversion": text.encode("utf-8", "replace")}
    ids = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}|{record_id}')}>" for kind in blocks}
    kinds = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
    out = []
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        own = digest(blocks[kind])
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", ids[other]), ("WARC-Block-Digest", own), ("Content-Type", kinds[kind]), ("Content-Length", str(len(blocks[kind])))]
        out.append({"record_id": ids[kind], "record_type": kind, "refers_to": record_id, "concurrent_to": ids[other], "target_uri": uri, "date": date, "content_type": kinds[kind], "block_digest": own, "source_digest": source, "n_links": len(links), "headers": [{"name": n, "value": v} for n, v in headers if v is not None], "block": blocks[kind]})
    return out


def _schema(kind: pa.DataType) -> pa.Schema:
    text = {n: pa.string() for n in ("record_id", "record_type", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "source_digest")}
    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    return pa.schema([("key", kind), *text.items(), ("n_links", pa.int64()), ("headers", header), ("block", pa.binary())])


def derivatives(responses: DataFrame, key_col: str = "key", id_col: str = "record_id", uri_col: str = "target_uri", date_col: str = "date", block_col: str = "block") -> DataFrame:
    """Two records (key, record_id, record_type, refers_to, ..., headers, block) for each response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("key").type)
            for a in range(0, batch.num_rows, 256):
                rows = [{"key": r["key"], **d} for r in batch.slice(a, 256).to_pylist() for d in derive(r["id"], r["uri"], r["date"], r["block"])]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kind = responses.schema[key_col].dataType.simpleString()
    rows = responses.select(F.col(key_col).alias("key"), F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(date_col).alias("date"), F.col(block_col).cast("binary").alias("block"))
    return rows.mapInArrow(run, f"key {kind}, {RECORD}").withColumnRenamed("key", key_col)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html), with name-based ids; null html is an empty payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url")))
    part = lambda a, n: F.substring(name, a, n)
    record = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    return pages.select(F.col("page_id").alias("key"), record.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"))


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _size(headers: dict[str, str]) -> int:
    """The length of the block, or -1 where the header has none that makes sense."""
    value = headers.get("content-length", "")
    return int(value) if re.fullmatch(r"[0-9]{1,18}", value, re.A) else -1


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of records from the parts of a file between the separators ``SEPARATOR``.

    A block that holds the separator itself comes in several parts, which its length tells.  A
    part that is no record, or whose block is not as long as it says, is left out, and the next one is read.
    """
    held: deque[bytes] = deque()
    ended, ahead = False, 0
    while held or not ended:
        if not held:
            part = next(parts, None)
            if part is None:
                return
        else:
            part = held.popleft()
            ahead -= len(SEPARATOR) + len(part)
        head, found, block = part.partition(b"\r\n\r\n")
        headers = _headers(head) if found else {}
        want, have, more = _size(headers), len(block), []
        if not 0 <= want <= LARGEST or (ended and want > have + ahead):
            continue
        while have < want:
            if held:
                after = held.popleft()
            else:
                after = next(parts, None)
                if after is None:
                    ended = True
                    break
                ahead += len(SEPARATOR) + len(after)
            more.append(after)
            have += len(SEPARATOR) + len(after)
        if have == want or have - want == 4 or (have > want and not more):
            ahead -= sum(len(SEPARATOR) + len(x) for x in more)
            yield headers, SEPARATOR.join([block, *more])[:want]
        else:
            held.extendleft(reversed(more))


#: What stands between two records: the end of the one and the start of the other.
SEPARATOR = b"\r\n\r\nWARC/1."
#: Blocks that say they are longer are taken for malformed; no value of Spark's holds as much.
LARGEST = (1 << 31) - 1


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, plain or gzipped; what is cut off or malformed is left out."""
    if raw[:2] == b"\x1f\x8b":
        out = []
        while raw:
            machine = zlib.decompressobj(31)
            try:
                out.append(machine.decompress(raw))
            except zlib.error:
                break
            raw = machine.unused_data
        raw = b"".join(out)
    return records(iter((b"\r\n\r\n" + raw).split(SEPARATOR)[1:]))


def warc_bytes(records: DataFrame) -> DataFrame:
    """The records with their serialised form in the column ``warc``, by DataFrame functions."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")
    return records.withColumn("warc", F.concat(F.concat(F.lit("WARC/1.1\r\n"), lines, F.lit("\r\n\r\n")).cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary")))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records (key, record_id, target_uri, date, block) of WARC files, plain or gzipped.

    Spark's reader unpacks a file and cuts it at the separator, so a task holds a record and not a file; of a
    file that is cut off the whole records come.  Only an uncompressed file is split between tasks; a block with the separator inside
    that reaches over such a cut is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(name: str, first: pa.RecordBatch) -> Iterator[bytes]:
            # all parts of one file, as far as they follow one another
            nonlocal waiting
            batch = first
            while batch is not None:
                names = batch.column("name").to_pylist()
                n = next((k for k, x in enumerate(names) if x != name), len(names))
                for value in batch.column("value").slice(0, n):
                    yield value.as_py()
                if n < len(names):
                    waiting = batch.slice(n)
                    return
                batch = next(batches, None)
            waiting = None

        waiting = next(batches, None)
        while waiting is not None:
            if not waiting.num_rows:
                waiting = next(batches, None)
                continue
            name = waiting.column("name")[0].as_py()
            for h, block in records(parts(name, waiting)):
                if h.get("warc-type", "").lower() == "response":
                    own = h.get("warc-record-id")
                    yield pa.RecordBatch.from_pydict({"key": [f"{name}#{own or digest(block)}"], "record_id": pa.array([own], pa.string()), "target_uri": pa.array([h.get("warc-target-uri")], pa.string()), "date": pa.array([h.get("warc-date")], pa.string()), "block": pa.array([block], pa.binary())})

    files = spark.read.option("lineSep", SEPARATOR.decode()).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(path)
    # the first record of a file has no separator before it; where the version stands there is no header line to lose
    rows = files.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(run, "key string, record_id string, target_uri string, date string, block binary")
