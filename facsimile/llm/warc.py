"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives two records. Both refer to it (WARC-Refers-To with its URI and date),
keep its target URI, date, payload digest and the HTTP headers it came with, and name
each other (WARC-Concurrent-To). Record ids are derived from the response's id, so a
repeated run writes the same records. Digests are SHA-1 in base32.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive, so that an unclosed tag is given up at once.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
#: Elements that begin a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
HEADERS = "map<string,string>"
RECORDS = f"kind string, record_id string, headers {HEADERS}, links array<string>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(response_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} of {response_id}')}>"


def read_page(page: str) -> tuple[str, str, list[str]]:
    """(title, text, hrefs in order): text has a line per block element, without markup, scripts and comments."""
    parts: list[str] = []
    hrefs: list[str] = []
    title, title_at, at = "", None, 0
    for match in MARKUP.finditer(page):
        parts.append(html.unescape(page[at : match.start()]).replace("\n", " "))
        at = match.end()
        name = (match[3] or "").lower()
        if name == "title":
            if match[2]:
                title = title or " ".join("".join(parts[title_at or 0 :]).split())
            else:
                title_at = len(parts)
        if name == "a" and not match[2] and (href := HREF.search(match[4])):
            hrefs.append(html.unescape(next(g for g in href.groups() if g is not None)).strip())
        if name in BLOCKS:
            parts.append("\n")
    parts.append(html.unescape(page[at:]).replace("\n", " "))
    lines = (SPACE.sub(" ", line).strip() for line in "".join(parts).split("\n"))
    return title, "\n".join(line for line in lines if line), hrefs


def absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # no valid address: kept as written
        return href


def _one_line(value: str | None, line_end: dict[str, str]) -> str | None:
    """A header value; a line end in it would begin another header."""
    return value if value is None else value.translate(str.maketrans(line_end))


def derive(response_id: str | None, uri: str, date: str | None, source: dict[str, str], payload: str) -> list[dict]:
    """The metadata and the conversion record of a response."""
    source_digest = digest(payload.encode())
    name = "\0".join((uri, date or "", source_digest)) if response_id is None else response_id
    response_id, date = _one_line(response_id or "", {"\r": " ", "\n": " "}), _one_line(date, {"\r": " ", "\n": " "})
    uri = _one_line(uri, {"\r": "%0D", "\n": "%0A"})
    title, text, hrefs = read_page(payload)
    links = list(dict.fromkeys(absolute(uri, h) for h in hrefs if h))
    body = text.encode()
    fields = [("title", title), ("textLength", str(len(body)))] + [("outlink", link) for link in links]
    fields += [("sourceHeader", f"{k}: {v}") for k, v in sorted(source.items())]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()),
        "conversion": ("text/plain; charset=utf-8", body),
    }
    ids = {kind: derived_id(name, kind) for kind in blocks}
    out = []
    for kind, (content_type, block) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", response_id),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other),
            ("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
            ("Content-Length", str(len(block))),
        ]
        kept = [(k, v) for k, v in headers if v is not None]
        out.append({"kind": kind, "record_id": ids[kind], "headers": kept, "links": links, "block": block})
    return out


def derivatives(
    responses: DataFrame, id_col: str = "record_id", uri_col: str = "uri", date_col: str = "date", headers_col: str = "headers", payload_col: str = "payload"
) -> DataFrame:
    """Two rows per response: (row, kind, record_id, headers, links, block); ``row`` has the response's other columns.

    A null payload is empty and gives empty text; a null URI is empty and links stay as
    written; a null date leaves its headers out; null source headers are none; a null id
    gives an empty refers-to, and records named by the response's URI, date and digest.
    Line ends in an id, a URI or a date do not reach a header. Equal responses give equal records. Links are distinct,
    absolute and in order of appearance. An empty table gives an empty result; further
    columns, whatever their names, stay in ``row``.
    """
    own = {"a": id_col, "b": uri_col, "c": date_col, "e": payload_col}
    rows = responses.select(
        F.struct(*[F.col(f"`{c}`") for c in responses.columns if c != payload_col]).alias("row"),
        *[F.col(f"`{c}`").cast("string").alias(name) for name, c in own.items()],
        F.col(f"`{headers_col}`").cast(HEADERS).alias("d"),
    )

    def emit(batches):
        schema = pa.schema(
            [
                ("kind", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string())),
                ("block", pa.binary()),
            ]
        )
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                fields = zip(*(batch.column(c).to_pylist() for c in "abcde"))
                made = [r for a, b, c, d, e in fields for r in derive(a, b or "", c, dict(d or {}), e or "")]
                table = pa.RecordBatch.from_pylist(made, schema=schema)
                twice = pa.array([n // 2 for n in range(2 * len(batch))], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("row").take(twice), *table.columns], names=["row", *schema.names])

    return rows.mapInArrow(emit, f"row {rows.schema['row'].dataType.simpleString()}, {RECORDS}")


#: Header order of a written record.
ORDER = (
    "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Refers-To WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-Concurrent-To "
    "WARC-Source-Payload-Digest WARC-Block-Digest Content-Type Content-Length"
).split()


def record_bytes(headers: Column, block: Column) -> Column:
    """A record as it stands in a WARC 1.1 file."""
    lines = [F.when(headers[k].isNotNull(), F.concat(F.lit(f"{k}: "), headers[k], F.lit("\r\n"))).otherwise("") for k in ORDER]
    return F.concat(F.encode(F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n")), "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
