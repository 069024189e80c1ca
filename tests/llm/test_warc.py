"""Records against a parser of the standard library."""

import base64
import hashlib
from html.parser import HTMLParser

from pyspark.sql import functions as F

from facsimile.llm.queries import op3_warc_derivatives
from facsimile.llm.warc import BLOCKS, derivatives, read_page, record_bytes

SCHEMA = "record_id string, uri string, date string, headers map<string,string>, payload string, row string, kind string"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hrefs, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.skip += 1
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.hrefs.append(dict(attrs)["href"].strip())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self.skip -= 1
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data.replace("\n", " "))


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    lines = (" ".join(x.replace("\xa0", " ").split(" ")) for x in "".join(parser.parts).split("\n"))
    text = "\n".join(x for x in (" ".join(y for y in x.replace("\t", " ").split(" ") if y) for x in lines) if x)
    return text, parser.hrefs


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for p in pages:
        _, text, hrefs = read_page(p.html)
        assert (text, hrefs) == plain(p.html)
    found = op3_warc_derivatives(spark, sf_dir).collect()
    assert len(found) == 2 * len(pages)
    texts = {r.page_id: r for r in found if r.kind == "conversion"}
    for p in pages:
        body = plain(p.html)[0].encode()
        r = texts[p.page_id]
        assert r.content_length == len(body) and r.block_sha1 == hashlib.sha1(body).hexdigest()
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()


def test_records(spark):
    page = (
        "<title>A &amp; <b>B</b></title><script>x<p>y</script><p>One<br/>two&nbsp;&lt;3</p>\n<!-- <a href='no'> --><a class=x href='/r?a=1&amp;b=2'>in</a>"
        '<a href="http://[bad">bad</a><a href="/r?a=1&b=2">again</a><style>p{}</style>tail<' + "z" * 100_000
    )
    rows = [
        ("<urn:uuid:1>", "http://h.example/p/", "2020-01-01T00:00:00Z", {"Server": "s"}, page, "x", "y"),
        ("<urn:uuid:2>", None, None, None, None, "x", "y"),
        (None, "http://h.example/", None, {}, "", "x", "y"),
        ("<urn:uuid:3>", "http://h.example/", None, {}, "<!-- open", "x", "y"),
    ]
    rows.append(rows[0])
    found = derivatives(spark.createDataFrame(rows, SCHEMA).repartition(2)).withColumn("bytes", record_bytes(F.col("headers"), F.col("block"))).collect()
    assert len(found) == 10 and {r.row.kind for r in found} == {"y"}
    by = {(r.row.record_id, r.kind): r for r in found}
    text, meta = by["<urn:uuid:1>", "conversion"], by["<urn:uuid:1>", "metadata"]
    assert bytes(text.block).decode() == "A & B\nOne\ntwo <3\ninbadagaintail<" + "z" * 100_000
    assert meta.links == ["http://h.example/r?a=1&b=2", "http://[bad"]
    assert b"title: A & B\r\n" in bytes(meta.block) and b"sourceHeader: Server: s\r\n" in bytes(meta.block)
    for r in found:
        head, _, rest = bytes(r.bytes).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields == r.headers and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert rest == bytes(r.block) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r.block)
        assert fields["WARC-Refers-To"] == (r.row.record_id or "") and fields["WARC-Record-ID"] == r.record_id
        other = by[r.row.record_id, "conversion" if r.kind == "metadata" else "metadata"]
        assert fields["WARC-Concurrent-To"] == other.record_id
    assert bytes(by["<urn:uuid:2>", "conversion"].block) == b"" and "WARC-Date" not in by["<urn:uuid:2>", "metadata"].headers
    assert bytes(by["<urn:uuid:3>", "conversion"].block) == b""


def test_null_ids_and_line_ends(spark):
    rows = [
        (None, "http://a.example/1", "2020-01-01T00:00:00Z", {}, "one", "x", "y"),
        (None, "http://a.example/2", "2020-01-01T00:00:00Z", {}, "one", "x", "y"),
        (None, "http://a.example/2", "2020-01-01T00:00:00Z", {}, "two", "x", "y"),
        (None, "http://a.example/2", "2020-01-01T00:00:00Z", {}, "two", "x", "y"),
        ("<urn:uuid:4>\r\nX-Evil: 2", "http://a\r\nX-Evil: 1", "2020\nX-Evil: 3", {"a\r\nX-Evil: 5": "v\r\nX-Evil: 4"}, "", "x", "y"),
    ]
    found = derivatives(spark.createDataFrame(rows, SCHEMA)).withColumn("bytes", record_bytes(F.col("headers"), F.col("block"))).collect()
    assert len({r.record_id for r in found}) == 8  # the two equal responses share theirs
    for r in found:
        head = bytes(r.bytes).partition(b"\r\n\r\n")[0].decode()
        assert "\nX-Evil" not in head and len(head.split("\r\n")) == 1 + len(r.headers)
        assert b"\nX-Evil" not in bytes(r.block)
    assert {r.headers["WARC-Target-URI"] for r in found if r.row.record_id} == {"http://a%0D%0AX-Evil: 1"}


def test_no_rows(spark):
    assert derivatives(spark.createDataFrame([], SCHEMA)).count() == 0
