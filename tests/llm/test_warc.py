import gzip
import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import duckdb
import pytest

from docsmith.llm import queries, warc

PAGE = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t='</p>';</script><!-- no --><h1>Top</h1><p>One <b>two</b>\n three &copy;<br>four</p><ul><li><a href=\"/x?a=1&amp;b=2\">link</a></li></ul><img src='i.png'></body></html>"


def pages(spark):
    return spark.createDataFrame([(1, "http://a.example/1", PAGE, "x"), (2, None, None, "x"), (3, "http://b.example/ü", "", "x"), (3, "http://b.example/ü", "", "x"), (4, "u", "plain < text > é " * 500, "x")], "page_id long, url string, html string, key string")


def test_records_refer_to_their_source(spark):
    responses = warc.responses_of_pages(pages(spark))
    source = {r.record_id: r for r in responses.collect()}
    rows = warc.derivatives(responses).collect()
    assert len(rows) == 2 * responses.count()
    for r in rows:
        s = source[r.refers_to]
        h = {x.name: x.value for x in r.headers}
        assert h["WARC-Refers-To"] == s.record_id and h["WARC-Type"] == r.record_type
        assert h["Content-Length"] == str(len(r.block))
        assert h.get("WARC-Target-URI") == s.target_uri
        assert r.block_digest == warc.digest(bytes(r.block))
        payload = bytes(s.block).partition(b"\r\n\r\n")[2]
        assert r.source_digest == warc.digest(payload)
        other = next(x for x in rows if x.record_id == r.concurrent_to)
        assert other.concurrent_to == r.record_id and other.record_type != r.record_type
    one = {r.record_type: r for r in rows if r.key == 1}
    assert bytes(one["conversion"].block).decode() == "Top\nOne two\nthree ©\nfour\nlink"
    fields = bytes(one["metadata"].block).decode().split("\r\n")
    assert "title: A & B" in fields and "outlink: /x?a=1&b=2 a/@href" in fields and "outlink: i.png img/@src" in fields
    assert "source-status: HTTP/1.1 200 OK" in fields and "source-header-content-type: text/html; charset=utf-8" in fields
    assert [bytes(r.block) for r in rows if r.key == 2 and r.record_type == "conversion"] == [b""]


def test_round_trip_through_files(spark, tmp_path):
    responses = warc.responses_of_pages(pages(spark)).collect()
    raw = b""
    for r in responses:
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", r.record_id), ("WARC-Date", r.date), ("Content-Type", "application/http"), ("Content-Length", str(len(r.block)))]
        raw += warc.serialise(headers + ([("WARC-Target-URI", r.target_uri)] if r.target_uri else []), bytes(r.block))
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :]))
    read = warc.read_responses(spark, str(tmp_path)).collect()
    want = sorted((r.record_id, bytes(r.block)) for r in responses)
    for name in ("a.warc", "b.warc.gz"):
        assert sorted((r.record_id, bytes(r.block)) for r in read if name in r.key) == want
    written = warc.warc_bytes(warc.derivatives(warc.responses_of_pages(pages(spark)))).collect()
    for r in written:
        (headers, block), = warc.parse(bytes(r.warc))
        assert block == bytes(r.block) and headers["warc-record-id"] == r.record_id


def test_odd_blocks():
    for block in (None, b"", b"HTTP/1.1 200 OK", b"\xff\xfe", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n folded\r\n\r\ncaf\xe9"):
        a, b = warc.derive(None, None, None, block)
        assert a["refers_to"] == b["refers_to"] and a["refers_to"].startswith("<urn:uuid:")
    assert b["block"].decode() == "café"
    assert warc.digest(b"") == "sha1:" + "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_empty_table(spark):
    assert warc.derivatives(warc.responses_of_pages(pages(spark).limit(0))).count() == 0


class Other(HTMLParser):
    """The same reading by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.names, self.hidden = [], [], [], None
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        self.text.append("\n" if tag in warc.BLOCKS else " " if tag == "img" else "")
        wanted = warc.LINKED.get(tag)
        for name, value in attrs:
            if name == wanted:
                self.links.append((tag, name, (value or "").strip()))
                break
        if tag in warc.HIDDEN:
            self.hidden = tag
            if tag == "title":
                self.names.append("")

    def handle_endtag(self, tag):
        if self.hidden == tag:
            self.hidden = None
            self.text.append(" ")
        elif not self.hidden:
            self.text.append("\n" if tag in warc.BLOCKS else "")

    def handle_comment(self, data):
        self.text.append("" if self.hidden else " ")

    def handle_decl(self, decl):
        self.text.append("" if self.hidden else " ")

    def handle_data(self, data):
        if self.hidden == "title":
            self.names[-1] += data
        elif not self.hidden:
            self.text.append(data)

    def result(self):
        text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[^\S\n]+", " ", "".join(self.text))).strip()
        return text, self.names[0] if self.names else None, self.links


def test_pages_read_as_by_another_parser():
    rng = random.Random(5)
    words = ["one", "two &amp; three", "caf\u00e9", "a  b", "x&lt;y", "line\nbreak", "&#65;&#x42;", "5 > 4"]
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            tag = rng.choice(["p", "div", "b", "a", "img", "li", "script", "style", "title", "link", "span", "br", "h1"])
            value = rng.choice(["/x", "http://e.example/?a=1&amp;b=2", "a > b", "", "it's"])
            attributes = rng.choice(["", f' href="{value}"', f' id=x src="{value}" alt="no > end"', " checked href=/plain", f' class="c"\n href="{value}"'])
            inner = rng.choice(words)
            if tag in ("script", "style"):
                inner = rng.choice(["var a = 1 < 2;", "p > q {}", "x = '<p>';"])
            elif tag == "title":
                inner = rng.choice(["A title", "One &amp; two"])
            parts.append(f"<{tag}{attributes}>" + ("" if tag in ("img", "link", "br") else f"{inner}</{tag}>") + rng.choice(["", " ", "\n", "<!-- c <p> -->", "text"]))
        pages.append("".join(parts))
    for page in pages:
        assert warc.read_page(page) == Other(page).result()


@pytest.mark.parametrize("unit", ["<a ", "<a href=\"", "<!--", "<", "<p", "<script>", "<a b='", "&#", "<title>", "=", "<a =", "</", "<![", " \n", "&#x", "<a href = "])
def test_broken_pages_take_time_in_proportion(unit):
    page = unit * (5_000_000 // len(unit))
    began = time.perf_counter()
    warc.read_page(page)
    assert time.perf_counter() - began < 8
    warc.read_page(unit * 1000 + "&#" + "9" * 9000 + ";&#x" + "f" * 9000 + ";&#" + "0" * 9000 + "65;")


def test_odd_charsets_and_codings():
    body = "caf\u00e9 <b>x</b>".encode()

    def text(headers, payload):
        return warc.derive("i", "u", None, b"HTTP/1.1 200 OK\r\n" + headers + b"\r\n\r\n" + payload)[1]["block"].decode()

    for name in ("undefined", "idna", "punycode", "unicode_escape", "rot13", "hex", "base64", "utf-7", "no-such", "\u00fc", "utf-8", "x" * 300, "mbcs", "oem"):
        assert text(f"Content-Type: text/html; charset={name}".encode(), body) == "caf\u00e9 x"
    assert text(b"Content-Type: text/html; charset='utf-16-le'", "\u00e9\ud83d\ude00".encode("utf-16-le", "surrogatepass")) == "\u00e9\U0001f600"
    assert text(b"X: y", b"<meta charset=latin-1>caf\xe9") == "caf\u00e9"
    assert text(b"Content-Encoding: gzip", gzip.compress(body)) == "caf\u00e9 x"
    assert text(b"Content-Encoding: gzip", body) == "caf\u00e9 x"
    assert text(b"Content-Encoding: deflate", zlib.compress(body)) == "caf\u00e9 x"
    long = b"word " * 60000
    cut = text(b"Content-Encoding: gzip", gzip.compress(bytes(random.Random(1).choices(b"abcdefgh \n", k=300000)))[:60000])
    assert len(cut) > 1000
    chunked = b"".join(b"%x;e=1\r\n%s\r\n" % (len(long[k : k + 4000]), long[k : k + 4000]) for k in range(0, len(long), 4000)) + b"0\r\n\r\n"
    assert text(b"Transfer-Encoding: chunked", chunked) == long.decode().strip()
    assert text(b"Transfer-Encoding: chunked", b"zz\r\nplain") == "zz\nplain"


def test_malformed_and_cut_off_files(spark, tmp_path):
    inner = b"HTTP/1.1 200 OK\r\n\r\nabout\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc"
    good = [warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>"), ("Content-Length", str(len(b)))], b) for k, b in enumerate([b"HTTP/1.1 200 OK\r\n\r\none", inner, b"", b"HTTP/1.1 200 OK\r\n\r\nlast"])]
    bad = [warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", "<bad>"), ("Content-Length", x)], b"body") for x in ("many", "-5", "99999", "9" * 30)]
    raw = good[0] + bad[0] + good[1] + bad[1] + bad[2] + good[2] + bad[3] + good[3]
    (tmp_path / "a.warc").write_bytes(raw)
    whole = b"".join(gzip.compress(x) for x in (good[0], good[1], good[3]))
    (tmp_path / "b.warc.gz").write_bytes(whole[: len(whole) - 30])
    assert [h["warc-record-id"] for h, _ in warc.parse(raw)] == ["<0>", "<1>", "<2>", "<3>"]
    assert [b for h, b in warc.parse(raw) if h["warc-record-id"] == "<1>"] == [inner]
    assert len(list(warc.parse(whole[: len(whole) - 30]))) >= 2
    read = [(r.record_id, bytes(r.block)) for r in warc.read_responses(spark, str(tmp_path / "a.warc")).collect()]
    assert sorted(x for x, _ in read) == ["<0>", "<1>", "<2>", "<3>"] and ("<1>", inner) in read
    warc.read_responses(spark, str(tmp_path / "b.warc.gz")).collect()


def test_registered_query(spark):
    rows = queries.op1_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    pages = {p: (u, h) for p, u, h in duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()}
    assert len(rows) == 2 * len(pages)
    for r in rows:
        url, page = pages[r.page_id]
        text, title, links = Other(page).result()
        payload = page.encode()
        assert r.target_uri == url and r.n_links == len(links) and r.source_digest == warc.digest(payload)
        if r.record_type == "conversion":
            assert r.n_bytes == len(text.encode()) and r.block_digest == warc.digest(text.encode())
