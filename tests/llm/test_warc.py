import base64
import hashlib
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tabscope.llm.warc import derivatives, page_links, plain_text, record_id, responses_of_pages


def test_text_and_links():
    page = (
        "<!DOCTYPE html><head><title>T &amp; t</title><style>p{a:b}</style><script>var x='</p>';</script></head>"
        "<!-- no <p> --><p>One <b>two</b>&nbsp;three<br>four&#33;<p>caf&eacute; <a title='>' href=\"/a?x=1&amp;y=2\">link</a>"
        "<a href=b.html>b</a><a href='b.html'>again</a><a name=x>none</a><a href='http://[bad'>bad</a>"
    )
    assert plain_text(page).split("\n") == ["One two three", "four!", "café linkbagainnonebad"]
    assert page_links(page, "http://e.org/d/p") == ["http://e.org/a?x=1&y=2", "http://e.org/d/b.html", "http://[bad"]
    assert plain_text("") == "" and plain_text("<script>never closed") == "" and plain_text("a < b") == "a < b"


class Visible(HTMLParser):
    """Visible words by the standard parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.words, self.hrefs = 0, [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "title")
        self.hrefs += tag == "a"

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


def test_records_link_back(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r["page_id"]: r for r in given.collect()}
    responses = {r["page_id"]: r for r in responses_of_pages(given).collect()}
    by_page = defaultdict(dict)
    for row in derivatives(responses_of_pages(given)).collect():
        by_page[row["page_id"]][row["record_type"]] = row
    assert set(by_page) == set(pages)
    for key, records in by_page.items():
        assert set(records) == {"metadata", "conversion"}
        page = pages[key]["html"]
        source = "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
        for kind, row in records.items():
            block = row["block"].encode()
            assert row["refers_to"] == responses[key]["record_id"] and row["source_digest"] == source
            assert row["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            headers = dict(line.split(": ", 1) for line in row["header"].split("\r\n")[1:] if line)
            assert headers["WARC-Type"] == kind and headers["Content-Length"] == str(len(block))
            assert headers["WARC-Refers-To"] == row["refers_to"] and headers["WARC-Block-Digest"] == row["block_digest"]
            assert headers["WARC-Refers-To-Payload-Digest"] == source
            assert headers["WARC-Target-URI"] == row["target_uri"] == pages[key]["url"]
        assert "http-header: Content-Type: text/html; charset=utf-8" in records["metadata"]["block"]
        parser = Visible()
        parser.feed(page)
        assert records["conversion"]["block"].split() == parser.words


def test_edges(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "http://a\r\nX: y", "<p>" + "w " * 100_000, "x"), (None, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    found = derivatives(responses_of_pages(df)).collect()
    assert len(found) == 8 and len({r["record_id"] for r in found}) == 6
    assert all("\r\nX: y" not in r["header"] for r in found)
    assert derivatives(responses_of_pages(df.limit(0))).collect() == []


@pytest.mark.parametrize(
    "part", ["<a ", "<title ", "<!--", "<script", "<a '", '<a "', "<a \"'", "<", "</", "<title>", "<script>", "<a href=", "&", "<p\n", " "]
)
def test_a_megabyte_of_broken_markup_is_read_at_once(part):
    page = part * (1_000_000 // len(part))
    begun = time.perf_counter()
    plain_text(page)
    page_links(page + ">", "http://e.org/")
    assert time.perf_counter() - begun < 20


def test_broken_tags_are_text():
    assert plain_text("a <b class='x> c") == "a <b class='x> c"
    assert plain_text("a <i \"'\">b</i> <i \"'\"'>'>c") == "a b c"
    assert plain_text("x<scripty>y</scripty>z<SCRIPT src=a>hidden</Script >seen") == "x\ny\nz\nseen"
    assert plain_text("<title>one</title>text<title>two") == "text"
    assert plain_text("<!-->still") == "" and plain_text("<!-- a --> b <!-- c") == "b"


def test_invalid_bytes_become_replacement_characters(spark):
    page = F.expr("cast(X'3C623E61FF62' as string)")
    given = spark.range(1).select(F.col("id").alias("page_id"), F.lit("http://e.org").alias("url"), page.alias("html"))
    records = {r["record_type"]: r for r in derivatives(responses_of_pages(given)).collect()}
    assert records["conversion"]["block"] == "a�b"


def test_responses_are_built_without_python(spark):
    rows = [(1, "http://e.org/é", "x"), (None, None, None), (-3, "", "y"), (4, "http://e.org/\n漢", "z"), *((i, f"u{i}", "p") for i in range(5, 40))]
    built = responses_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert "Arrow" not in built._jdf.queryExecution().executedPlan().toString()
    wanted = {(key, record_id("response", "" if key is None else str(key), url or "")) for key, url, _ in rows}
    assert {(r["page_id"], r["record_id"]) for r in built.collect()} == wanted


def test_broken_tags_before_one_quote_are_read_at_once():
    begun = time.perf_counter()
    assert plain_text("<a " * 300_000 + '">') == ("<a " * 300_000 + '">')
    assert time.perf_counter() - begun < 20
