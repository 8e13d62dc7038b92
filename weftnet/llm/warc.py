"""Derivatives of web captures: metadata and plain-text conversion records linked to their response records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, slices

#: Elements whose content is not shown; those that start a line; those that stand apart on it; those that link, with the attributes that hold targets.
HIDDEN = frozenset("script style template noscript title".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd br hr tr table section article nav main aside header footer body html head blockquote pre form".split())
CELLS = frozenset(("td", "th"))
LINKING, TARGETS = frozenset("a area link img iframe script".split()), frozenset(("href", "src"))
NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
#: One attribute, or the end of its tag; a quote that never closes takes what is left.
ATTRIBUTE = re.compile(r"[\s/]*+(?:(?P<end>>)|(?P<name>=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"(?P<double>[^\"]*+)\"?|'(?P<single>[^']*+)'?|(?P<bare>[^\s>]*+)))?)")
CLOSES = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*+>?", re.I) for n in HIDDEN}
GAPS = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(kind: str, source_id: str) -> str:
    """A record id that a rerun gives again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source_id}')}>"


def read_page(page: str) -> tuple[str, str | None, list[tuple[str, str]]]:
    """What a page shows, its title, and the targets of its links with the element and attribute that hold them.

    No scripts, styles, templates, comments or title are shown; blocks start lines; table cells stand apart; entities become characters. The page
    is read once from left to right, so that the time is linear whatever the markup: what is open at the end, a comment,
    a tag, a quote or a hidden element, ends with the page.
    """
    shown: list[str] = []
    found: list[tuple[str, str]] = []
    title = None
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        shown.append(page[at:start])
        follows = page[start + 1 : start + 2]
        name = NAME.match(page, start)
        if not name:
            if follows in ("!", "?", "/"):
                end = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start)
                at = n if end < 0 else page.index(">", end) + 1
            else:
                shown.append("<")
                at = start + 1
            continue
        tag, at, seen = name[1].lower(), name.end(), set()
        plain = page.startswith(">", at)  # most tags have no attributes
        at += plain
        while at < n and not plain:
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if m["end"]:
                break
            key = m["name"].lower()
            if key in TARGETS and tag in LINKING and follows != "/" and key not in seen:
                seen.add(key)
                target = next((m[g] for g in ("double", "single", "bare") if m[g] is not None), None)
                if target is not None:
                    found.append((html.unescape(target).strip(), f"{tag}/@{key}"))
        if tag in BLOCKS:
            shown.append("\n")
        elif tag in CELLS:
            shown.append(" ")
        elif tag in HIDDEN and follows != "/":
            close = CLOSES[tag].search(page, at)
            if tag == "title" and title is None:
                title = GAPS.sub(" ", html.unescape(page[at : close.start() if close else n]).replace("\n", " ")).strip()
            at = close.end() if close else n
    shown.append(page[at:])
    lines = (GAPS.sub(" ", html.unescape(x)).strip() for x in "".join(shown).split("\n"))
    return "\n".join(x for x in lines if x), title, found


def plain_text(page: str) -> str:
    return read_page(page)[0]


def links(page: str) -> list[tuple[str, str]]:
    return read_page(page)[2]


def record(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)


def derive(source_id: str, uri: str, date: str, http: str, page: str) -> list[tuple]:
    """The metadata and the conversion record of one response, in that order."""
    payload = page.encode("utf-8", "surrogatepass")
    whole = http.encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload
    shown, title, found = read_page(page)
    fields = [("source-record", source_id), ("source-block-digest", digest(whole)), ("source-payload-digest", digest(payload))]
    fields += [(f"source-http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:]) if k.strip()]
    fields += [("source-http-status", http.split("\r\n")[0])] if http else []
    fields += [("title", title)] if title is not None else []
    fields += [("outlink", f"{to} {where}") for to, where in found]
    about = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", shown)):
        data = block.encode("utf-8", "surrogatepass")
        name = derived_id(kind, source_id)
        head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source_id), ("WARC-Target-URI", uri), ("WARC-Date", date)]
        head += [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
        head += [("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        out.append((kind, name, source_id, uri, content_type, digest(data), digest(payload), len(data), record(head), block))
    return out


SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, source_digest string, content_length long, headers string, block string"


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A table of pages (page_id, url, html) as response records: page_id, record_id, target_uri, date, http, payload."""
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit(""))))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("long"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http"), F.coalesce("html", F.lit("")).alias("payload"),
    )


def derivatives(captures: DataFrame) -> DataFrame:
    """Two rows for each response record: its metadata and its plain-text conversion, headers and block as they are written.

    Null fields count as empty, and an empty payload gives an empty conversion; a null page_id stays null. Markup that never
    ends is read as far as it goes, in linear time, so that pages of any length are read whole; repeated rows give repeated
    records with the same ids; further columns, whatever their names, are ignored; an empty table gives no rows.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "content_length") else pa.string()) for n in names])
        for batch in batches:
            for part in slices(batch, "payload"):
                rows = [(r["page_id"], *x) for r in part.to_pylist() for x in derive(r["record_id"], r["target_uri"], r["date"], r["http"], r["payload"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(names), schema, strict=True)], schema=schema)

    bounded_batches(captures.sparkSession)
    return captures.select("page_id", *map(text, ("record_id", "target_uri", "date", "http", "payload"))).mapInArrow(run, SCHEMA)
