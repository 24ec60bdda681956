"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import by_value, map_rows

# Date and HTTP headers of responses that are built from pages, which carry none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"
PAGE_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# How a tag begins, and the elements whose content is not text.
TAG = re.compile(r"<([!?/]?)([a-z][^\s/>\"']*)", re.I)
# A whole tag, up to the first > outside of quotes; nothing of it is tried twice.
WHOLE_TAG = re.compile(r"""<([!?/]?)([a-z][^\s/>"']*+)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""", re.I)
HIDDEN = frozenset(("script", "style", "noscript", "template"))
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*HIDDEN, "title")}
QUOTE_OR_END = re.compile(r"""["'>]""")
# Elements that do not break a line.
INLINE = frozenset(
    "a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time tt u var".split()
)
TITLE = re.compile(r"<title\b", re.I)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# RFC 4122: the namespace of addresses.
URL_NAMESPACE = uuid.NAMESPACE_URL.hex


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that depends on the parts alone, so that a second run, or a retried task, gives the same."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts)).urn}>"


def _record_ids(*parts: Column) -> Column:
    """``record_id`` of columns."""
    name = F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.concat_ws("\n", *parts).cast("binary"))
    digits = F.sha1(name)
    variant = F.translate(F.substring(digits, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    groups = [
        F.substring(digits, 1, 8),
        F.substring(digits, 9, 4),
        F.concat(F.lit("5"), F.substring(digits, 14, 3)),
        F.concat(variant, F.substring(digits, 18, 3)),
        F.substring(digits, 21, 12),
    ]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def titles(page: str) -> Iterator[tuple[int, int, str]]:
    """Title elements in order: where each begins and ends, and its content. An unclosed one ends with the page."""
    at = 0
    while (tag := TITLE.search(page, at)) and (opened := page.find(">", tag.end())) >= 0:
        closed = CLOSING["title"].search(page, opened)
        end = closed.start() if closed else len(page)
        at = closed.end() if closed else end
        yield tag.start(), at, page[opened + 1 : end]


class _TagEnds:
    """Where tags end: at the first > outside of quotes. Each quote and > is looked at once, however many tags are broken."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.start, self.place = 0, -1  # from start to place nothing is a quote or >

    def special(self, at: int) -> int:
        if not self.start <= at <= self.place:
            found = QUOTE_OR_END.search(self.page, at)
            self.start, self.place = at, found.start() if found else len(self.page)
        return self.place

    def after(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at ``at``; -1 if a quote or the tag stays open."""
        seen, found = [], -1
        while (at := self.special(at)) < len(self.page):
            if at in self.known:
                found = self.known[at]
                break
            seen.append(at)
            if self.page[at] == ">":
                found = at
                break
            at = self.page.find(self.page[at], at + 1) + 1
            if not at:
                break
        self.known.update(dict.fromkeys(seen, found))
        return found


def markup(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Comments, hidden elements and tags in order: where each begins and ends, the name of a tag and its attributes.

    One scan, linear in the page also where nothing is closed: comments and hidden elements then end with the page, and
    a broken tag is text.
    """
    at, ends, broken = 0, _TagEnds(page), False
    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        # Until a tag is broken, one pattern takes each whole; from then on its end is looked up among those known.
        if at < last and not broken and (tag := WHOLE_TAG.match(page, at)):
            slash, name, attributes = tag.groups()
            name = name.lower()
            if slash or name not in HIDDEN:
                end = tag.end()
                yield at, end, name, attributes
                at = end
                continue
        if page.startswith("<!--", at):
            closed = page.find("-->", at + 4)
            end = len(page) if closed < 0 else closed + 3
            yield at, end, "", ""
            at = end
            continue
        tag = TAG.match(page, at) if at < last else None
        name = tag[2].lower() if tag else ""
        if tag and not tag[1] and name in HIDDEN:
            closed = CLOSING[name].search(page, page.find(">", tag.end()))
            end = closed.end() if closed else len(page)
            yield at, end, "", ""
            at = end
        elif tag and (end := ends.after(tag.end())) >= 0:
            yield at, end + 1, name, page[tag.end() : end]
            at = end + 1
        else:
            broken = broken or tag is not None
            at += 1


def _without(page: str, parts: Iterator[tuple[int, int, str]]) -> str:
    pieces, at = [], 0
    for start, end, instead in parts:
        pieces += [page[at:start], instead]
        at = end
    return "".join([*pieces, page[at:]])


def plain_text(page: str) -> str:
    """Visible text: markup out, a line break at every block element, character references resolved, space folded."""
    page = _without(page, ((start, end, "\n") for start, end, _ in titles(page)))
    text = _without(page, ((start, end, "" if name in INLINE else "\n") for start, end, name, _ in markup(page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_links(page: str, base: str) -> list[str]:
    """Targets of the anchors in order, made absolute, each once."""
    links: dict[str, None] = {}
    for _, _, name, attributes in markup(page):
        if name == "a" and (found := HREF.search(attributes)):
            target = html.unescape(next(x for x in found.groups() if x is not None)).strip()
            try:
                links.setdefault(urljoin(base, target))
            except ValueError:  # not an address: kept as it is written
                links.setdefault(target)
    return list(links)


def _valid(value: Column) -> Column:
    """As text; missing values are empty, and bytes that are no UTF-8 become the replacement character."""
    return F.make_valid_utf8(F.coalesce(value.cast("string"), F.lit("")))


def one_line(value: str) -> str:
    return " ".join(value.split())


def responses_of_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = PAGE_DATE
) -> DataFrame:
    """Response records of pages: key, record_id, target_uri, date, http_headers and payload.

    The identifier follows from key and address. Missing addresses and pages become empty ones.
    """
    columns = {name: _valid(F.col(f"`{name}`")) for name in (key, url, page)}
    return pages.select(
        F.col(f"`{key}`").alias(key),
        _record_ids(F.lit("response"), columns[key], columns[url]).alias("record_id"),
        columns[url].alias("target_uri"),
        columns[page].alias("payload"),
        F.lit(date).alias("date"),
        F.lit(PAGE_HEADERS).alias("http_headers"),
    )


def derive(key, source_id: str, uri: str, date: str, http: str, payload: str) -> Iterator[tuple]:
    """The metadata and the conversion record of one response."""
    body = payload.encode()
    source = {
        "WARC-Target-URI": one_line(uri),
        "WARC-Date": date,
        "WARC-Refers-To": source_id,
        "WARC-Refers-To-Payload-Digest": digest(body),
        "WARC-Refers-To-Block-Digest": digest(http.encode() + body),
    }
    title = next((content for _, _, content in titles(payload)), "")
    fields = [("title", one_line(html.unescape(title)))]
    fields += [("http-header", line) for line in http.split("\r\n") if line]
    fields += [("outlink", one_line(link)) for link in page_links(payload, uri)]
    metadata = "".join(f"{name}: {value}\r\n" for name, value in fields)
    ids = {kind: record_id(kind, source_id) for kind in ("metadata", "conversion")}
    for kind, other, content, block in (
        ("metadata", "conversion", "application/warc-fields", metadata),
        ("conversion", "metadata", "text/plain; charset=utf-8", plain_text(payload)),
    ):
        raw = block.encode()
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": ids[kind],
            **source,
            "WARC-Concurrent-To": ids[other],
            "WARC-Block-Digest": digest(raw),
            "Content-Type": content,
            "Content-Length": str(len(raw)),
        }
        text = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
        yield key, kind, ids[kind], source_id, source["WARC-Target-URI"], headers["WARC-Block-Digest"], source[
            "WARC-Refers-To-Payload-Digest"
        ], "WARC/1.1\r\n" + text + "\r\n", block


def derivatives(
    responses: DataFrame,
    key: str = "page_id",
    identifier: str = "record_id",
    uri: str = "target_uri",
    date: str = "date",
    http: str = "http_headers",
    payload: str = "payload",
) -> DataFrame:
    """Two rows per response: its metadata record (title, HTTP headers, links) and its plain-text conversion record.

    Rows: key, record_type, record_id, refers_to, target_uri, block_digest, source_digest, header (the record's WARC
    header) and block. Both name the response (WARC-Refers-To) with its address, date and digests, and each other. The
    identifiers follow from the response's, so repeated rows give equal records. Missing values count as empty; an
    empty page has an empty conversion; bytes that are no UTF-8 become the replacement character. Pages are read whole, in
    one linear scan; other columns are ignored; an empty table gives no rows.
    """
    names = (identifier, uri, date, http, payload)
    fields = ("key", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_digest", "header", "block")

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = [row for values in zip(*batch.values()) for row in derive(*values)]
            yield dict(zip(fields, zip(*rows))) if rows else {name: [] for name in fields}

    given = responses.select(
        F.col(f"`{key}`").alias("key"),
        *[_valid(F.col(f"`{name}`")).alias(f"v{i}") for i, name in enumerate(names)],
    )
    schema = f"key {responses.schema[key].dataType.simpleString()}, " + ", ".join(f"{name} string" for name in fields[1:])
    return map_rows(given, schema, task).withColumnRenamed("key", key)


def write_warc(records: DataFrame, path: str) -> None:
    """The records as text files of WARC syntax, one part per task."""
    whole = F.concat("header", "block", F.lit("\r\n\r\n"))
    records.select(whole.alias("value")).write.option("lineSep", "").text(path)


by_value(__name__)
