import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from pitchframe.llm.warc_derivatives import derivatives, responses, serialised

HTML = '<!doctype html><html lang="de"><head><title> A &amp; B </title><script>var x = "<p>";</script></head><body><nav>menu</nav><p>One <b>two</b></p><a href="/x">l</a><!-- no --><p>3 &lt; 4</p></body></html>'


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, block string, headers string")


def test_records_are_linked_and_digested(spark):
    df = pages(spark, [(1, "http://a/", HTML, "clash", "clash"), (2, None, None, "c", "c"), (1, "http://a/", HTML, "clash", "clash"), (3, "http://b/", "", None, None)])
    source = {r["page_id"]: r for r in responses(df).collect()}
    records = serialised(derivatives(responses(df))).collect()
    assert len(records) == 8
    for r in records:
        assert r["refers_to"] == source[r["page_id"]]["record_id"]
        assert r["payload_digest"] == source[r["page_id"]]["payload_digest"]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        head, block = bytes(r["warc"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n") and block[:-4].decode() == r["block"]
        assert f"WARC-Refers-To: <{r['refers_to']}>".encode() in head
    by_kind = {r["record_type"]: r for r in records if r["page_id"] == 1}
    assert by_kind["metadata"]["concurrent_to"] == by_kind["conversion"]["record_id"]
    assert by_kind["conversion"]["block"].split("\n") == ["One two", "l", "3 < 4"]
    assert "title: A &amp; B\r\nlanguage: de\r\nlinks: 1\r\n" in by_kind["metadata"]["block"]
    assert "source-content-length: " in by_kind["metadata"]["block"]


def test_an_empty_table_gives_an_empty_table(spark):
    assert derivatives(responses(pages(spark, []))).count() == 0


def test_long_pages_pass(spark):
    df = pages(spark, [(1, "u", "<p>" + "word <b>x</b> " * 50_000 + "</p>", "", "")])
    assert derivatives(responses(df)).filter(F.col("record_type") == "conversion").first()["content_length"] > 300_000


HOSTILE = {
    "<": 10**6, "<p ": 300_000, "<title>": 150_000, "<nav>": 150_000, "<head>": 150_000, "<html ": 150_000, "<a ": 300_000, "<!--": 200_000, "<script>": 100_000, "\f": 10**6, "\n \n": 300_000,
    "<html lang=\"": 80_000, "<title": 150_000, "</nav>": 100_000,
}


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_pages_take_seconds(spark, part):
    df = pages(spark, [(1, "u", part * HOSTILE[part] + "x", "", "")])
    began = time.monotonic()
    assert derivatives(responses(df)).select(F.length("block")).collect()
    assert time.monotonic() - began < 20


def plain(html):
    """The text of a page by a walk over its tags."""
    html = re.sub(r"(?s)<!--.*?(-->|\Z)", "", html)
    out, hidden, at = [], None, 0
    for tag in re.finditer(r"<(/?)([a-zA-Z0-9]+)\b[^<>]*>", html):
        if hidden is None:
            out.append(html[at : tag.start()])
        at = tag.end()
        close, name = tag[1] == "/", tag[2].lower()
        if hidden is not None:
            if close and name == hidden:
                out.append("\n" if hidden == "nav" else "")
                hidden = None
        elif not close and name in ("script", "style", "template", "head", "nav"):
            hidden = name
        elif name in "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer figure blockquote pre".split():
            out.append("\n")
    out.append(html[at:])
    text = re.sub(r"<[^<>]*>", "", "".join(out))
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r]+", " ", text)).strip()
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = text.replace(name, char)
    return text


def test_text_of_the_given_pages_equals_a_walk_over_tags(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = derivatives(responses(df)).filter("record_type = 'conversion'").select("page_id", "block").collect()
    source = {r["page_id"]: r["html"] for r in df.collect()}
    bad = [r["page_id"] for r in found if r["block"] != plain(source[r["page_id"]] or "")]
    assert len(found) == df.count() and not bad
