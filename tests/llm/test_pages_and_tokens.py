import base64
import gzip
import hashlib
import random
import struct
import time

import brute
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusmill.llm import sentencepiece as SP
from corpusmill.llm import warc
from corpusmill.llm.html_text import main_text
from corpusmill.llm.html_tree import blocks_of, text_without
from corpusmill.llm.queries import SENTENCEPIECE_MODEL

ODD = ["", "  ", " a  b ", "<s> x </s>", "▁x", "日本語 😀\x00\n\t", "a▁b", "   lead", " ", "<unk><0x41>", "é", "x" * 5000, "tab\tand\r\nlines\n\n"]


def test_tokens_as_the_library(spark, odd):
    docs = odd.select("doc_id", "text", "key").union(spark.createDataFrame([(1000 + i, t, "k") for i, t in enumerate(ODD)], "doc_id long, text string, key string"))
    rows = SP.encode_texts(docs.withColumn("tokens", F.lit(1)), SENTENCEPIECE_MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["tokens"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["tokens"]) == (r["text"] or "").replace("▁", " ")
    assert SP.round_trip(docs.limit(0), SENTENCEPIECE_MODEL).collect() == []
    assert all(r["same"] for r in SP.round_trip(docs, SENTENCEPIECE_MODEL).collect())


def test_bytes_that_are_no_text_are_decoded_as_by_the_library():
    library, mine = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL), SP.Encoder(SP.definition_of(SENTENCEPIECE_MODEL), 1)
    byte = lambda b: 3 + b
    for ids in ([], [byte(0xE2), byte(0x96), byte(0x81), 300], [300, byte(0xFF)], [28705, 300], [byte(0x41)], [byte(0xC3), byte(0xA9)]):
        assert mine.decode([np.array(ids, np.int64)])[0] == library.decode(ids), ids


def message(*parts):
    """Protobuf fields of numbers, bytes and floats."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram(tmp_path, squeeze):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "a", "b", "c", "ab", "▁ab", "▁a", "bc", "abc", "▁b", "▁▁"]
    pieces += [(w, -1.5 - 0.37 * i - 0.013 * i * i, 1) for i, w in enumerate(words)]
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    model += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1))), (3, message((1, b"identity"), (3, 1), (4, squeeze), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(model)
    return str(path)


@pytest.mark.parametrize("squeeze", [0, 1])
def test_a_unigram_model(tmp_path, squeeze):
    path = unigram(tmp_path, squeeze)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), SP.Encoder(SP.definition_of(path), 1)
    for text in ["ab abc  c", "  a b", "é abx", "abcabcab bc", "", "a", "b  ab "]:
        assert mine.encode([text])[0].tolist() == library.encode(text), text
        assert mine.decode([mine.encode([text])[0]])[0] == library.decode(library.encode(text))


PAGES = [
    ("<article><h1>T &amp; &#x41;</h1><p>a <b>b</b>c<br>d<p>e\n f</article><footer>no</footer>", "T & A\na bc d\ne f"),
    ("<nav>m</nav><main><h2>t</h2><ul><li>1<li>2</ul><div class='user-comments'>no</div><p>x</p></main>tail", "t\n1\n2\nx"),
    ("<body><div id=cookieNotice>no</div><p title='a>b'>x<script>if(a<b){'</p>'}</script>y<!-- z --></p>text", "xy\ntext"),
    ("<article><p>a<article class='comment'><p>no</article><aside>no</aside><form>no</form><p>b", "a\nb"),
    ("plain text &copy 1 < 2", "plain text © 1 < 2"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>one</b></div><i>two</p>three", "one two".replace(" ", "") + "\nthree"),
    ("", ""),
    ("<", "<"),
    ("<div " * 2000, ""),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_blocks_of_a_page(page, text):
    assert text_without(blocks_of(page), set()) == text


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<h2 id='related-work'>Related work</h2>", "Related work"),
        ("<h2 id='comments'>Comments</h2>", "Comments"),
        ("<section id='social-history'><p>It began.</p></section>", "It began."),
        ("<div id='notice-of-appeal' class=sidebarTheory>An appeal</div>", "An appeal"),
        ("<p>so <math><mi>x</mi></math> is</p>", "so x is"),
        ("<div class='ad-container'>Buy</div><div class='lead shareButtons'>Share</div>", ""),
        ("<ul class='related-links'><li>More</li></ul><section id=comments>Nice</section><div role=navigation>Up</div>", ""),
    ],
)
def test_names_inside_an_article_are_taken_whole(inside, text):
    page = f"<html><body><article><p>One</p>{inside}</article></body></html>"
    assert text_without(blocks_of(page), set()) == "\n".join(filter(None, ["One", text]))


def test_templates_are_counted_by_host(spark):
    """What recurs on a host goes, except for paragraphs of an article; other hosts keep it."""
    page = "<div><p>Site line</p><ul><li>Menu one<li>Menu two</ul></div><p>text {0}</p>"
    story = "<article><p>license</p><div><p>box</p></div><p>story {0}</p></article>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(6)] + [(10 + i, f"https://u@B.example:80/{i}", story.format(i)) for i in range(6)]
    rows += [(20, "http://c.example", page.format(20)), (21, None, page.format(21)), (None, None, None), (0, "http://a.example/0", page.format(0)), (22, "x", "")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, key int, host string")
    found = sorted(((r["page_id"], r["text"]) for r in main_text(df).collect()), key=str)
    whole = "Site line\nMenu one\nMenu two\ntext {0}"
    expect = [(i, f"text {i}") for i in [*range(6), 0]] + [(10 + i, f"license\nstory {i}") for i in range(6)] + [(20, whole.format(20)), (21, whole.format(21)), (None, ""), (22, "")]
    assert found == sorted(expect, key=str)
    assert main_text(df.limit(0)).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    """Copies under several addresses and repeated rows count as one page, with and without an article."""
    plain = "<div><h2>Head</h2><p>The whole story</p></div><p>end</p>"
    story = "<title>{0}</title><article><div class=entry><p>The whole story</p></div><ul><li>one</ul></article>"
    menu = "<div><p>Menu</p></div><p>text {0}</p>"
    rows = [(i, f"http://a.example/{i}", plain) for i in range(8)] + [(20 + i, f"http://b.example/{i}", story.format(i)) for i in range(8)]
    rows += [(40, "http://c.example/0", plain)] * 7 + [(50 + i, f"http://d.example/{i // 4}", menu.format(i // 4)) for i in range(20)]
    rows += [(80 + i, "http://e.example/", menu.format(i // 4)) for i in range(16)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = {i: "Head\nThe whole story\nend" for i in [*range(8), 40]} | {20 + i: "The whole story\none" for i in range(8)}
    assert found == whole | {50 + i: f"text {i // 4}" for i in range(20)} | {80 + i: f"Menu\ntext {i // 4}" for i in range(16)}


def test_a_template_on_a_small_share_of_a_large_host(spark):
    """Six pages of 400 have a section menu, four have a box that is too rare."""
    page = "<div><ul><li>Section menu</ul></div><p>text {0}</p>"
    rows = [(i, f"http://a.example/{i}", (page if i < 6 else page.replace("Section menu", "Box") if i < 10 else "<p>text {0}</p>").format(i)) for i in range(400)]
    found = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Box\ntext {i}" if 6 <= i < 10 else f"text {i}" for i in range(400)}


def test_templates_as_by_brute_force(spark):
    """Random nested pages, with text at every level, against whole subtrees counted as strings."""
    draw = random.Random(3)
    word = lambda n: "".join(draw.choices("abcdefgh", k=n))

    def tree(depth):
        tag = draw.choice(["div", "ul", "section", "blockquote"]) if depth else "li"
        inner = [draw.choice([word(1), tree(depth - 1)]) for _ in range(draw.randint(1, 3))] if depth else [word(draw.choice([1, 1, 6]))]
        return (tag, [x for i, x in enumerate(inner) if not (isinstance(x, str) and i and isinstance(inner[i - 1], str))])

    rows = [(i, f"http://h{i % 2}.example/{i // 3}", [tree(draw.randint(0, 3)) for _ in range(draw.randint(0, 5))]) for i in range(150)]
    df = spark.createDataFrame([(i, url, "".join(map(brute.markup, page))) for i, url, page in rows], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    expect = brute.site_texts([(i, url.split("/")[2], page) for i, url, page in rows], 5)
    assert found == expect and len({len(t) for t in found.values()}) > 20
    assert sum(len(brute.shown(page)) for _, _, page in rows) > sum(len(t.split()) for t in found.values())  # some are templates


def test_deep_and_unclosed_pages_take_time_in_proportion(spark):
    """A megabyte of nested blocks with text at each level, of tags that nothing closes, and of quotes that nothing closes."""
    begun = time.monotonic()
    deep = "".join(f"<div>x{i} {'y' * 40}" for i in range(20_000))
    page = blocks_of(deep)
    assert len(page.blocks) == len(page.subtrees) == 20_000 and text_without(page, {page.subtrees[7].digest}).count("\n") == 6
    df = spark.createDataFrame([(1, "http://a.example", deep)], "page_id long, url string, html string")
    assert main_text(df).first()["text"].count("\n") == 19_999
    for odd in ("<a " * 100_000, "<a href='x\">" * 80_000, "<a \">\"" * 100_000, "<title " * 100_000, "<script " * 100_000, "<p " * 100_000, "<!-- " * 100_000, "<a href=" * 80_000):
        warc.links(odd), warc.titles(odd), warc.plain_text(odd), blocks_of(odd) if '\">\"' not in odd else None
    assert time.monotonic() - begun < 60


@pytest.mark.parametrize(
    "page, found",
    [
        ("<a href='/b'>b</a><A class=x HREF = \"/c?a=1&amp;b=2\" >c</A><a href=/d>d<a href='/b'>", ["/b", "/c?a=1&b=2", "/d"]),
        ("<a title='a>b' href='x>y'>", ["x>y"]),
        ("<abbr href=no><a name=n>href=no<a\nhref=yes", ["yes"]),
        ("<a href='/open>one</a><a href=/two>", ["/two"]),
        ("", []),
    ],
)
def test_links_of_a_page(page, found):
    assert warc.links(page) == found


def test_pages_as_by_a_parser():
    """Text, title and links of random pages against the parser of the standard library."""
    draw = random.Random(4)
    parts = ["<p>", "</p>", "<b>", "</b>", "<div class='a>b'>", "</div>", "<br>", "one &amp; two", " x\n y ", "<a href='/{0}?a&lt;b'>", "<a id=k href=\"u {0}\">", "</a>", "<script>if (a) '<p>'</script>", "<!-- a > b -->", "<li>", "é{0}", "<title>T{0} &gt;</title>"]
    for _ in range(300):
        page = "".join(draw.choice(parts).format(draw.randrange(5)) for _ in range(draw.randrange(30))).replace("class='a>b'", "class='ab'")
        text, title, links = brute.parsed(page)
        assert (warc.plain_text(page), warc.titles(page), warc.links(page)) == (text, title, links), page


def pages(spark):
    rows = [(1, "http://x.example/a", "<title>T</title><p>Hi &amp; <a href='/b'>b</a><p>é"), (2, None, None), (3, "http://y\n.example", "<script>x</script>" + "z" * 100_000), (3, "http://y\n.example", "again")]
    return spark.createDataFrame([(*r, "headers") for r in rows], "page_id long, url string, html string, headers string")


def test_records_are_written_and_read_again(spark, tmp_path):
    for name, records in (("r", warc.response_records(pages(spark))), ("d", warc.derived_records(warc.response_records(pages(spark))))):
        warc.write_warc(records, str(tmp_path / name), records_per_file=3)
        back = warc.read_warc(spark, str(tmp_path / name)).collect()
        assert sorted(map(str, back)) == sorted(map(str, records.collect())) and len(back) == (4 if name == "r" else 8)


def test_derived_records_refer_to_their_source(spark):
    responses = {dict(r["headers"])["WARC-Record-ID"]: (dict(r["headers"]), bytes(r["content"])) for r in warc.response_records(pages(spark)).collect()}
    derived = [(dict(r["headers"]), bytes(r["content"])) for r in warc.derived_records(warc.response_records(pages(spark))).collect()]
    assert len({h["WARC-Record-ID"] for h, _ in derived}) == 8
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for h, block in derived:
        source, content = responses[h["WARC-Refers-To"]]
        assert h.get("WARC-Target-URI") == source.get("WARC-Target-URI") and h["WARC-Date"] == source["WARC-Date"]
        assert h["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"] == sha1(content.split(b"\r\n\r\n", 1)[1])
        assert h["WARC-Block-Digest"] == sha1(block) and h["Content-Length"] == str(len(block))
    one = {h["WARC-Type"]: b for h, b in derived if h.get("WARC-Target-URI") == "http://x.example/a"}
    assert one["conversion"].decode() == "Hi & b\né"
    lines = one["metadata"].decode().split("\r\n")
    assert "http-status: HTTP/1.1 200 OK" in lines and "title: T" in lines and "outlink: /b" in lines and "payload-digest-match: true" in lines
    assert any(x.startswith("source-warc-record-id: <urn:uuid:") for x in lines) and "http-content-type: text/html; charset=utf-8" in lines


def test_records_of_odd_sources(spark):
    rows = [([("WARC-Type", "request")], b"x"), ([("warc-type", "response")], "no header é".encode("latin-1")), (None, None), ([("WARC-Type", "response"), (None, None)], None)]
    derived = warc.derived_records(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert len(derived) == 4 and sum(bytes(r["content"]) == "no header �".encode() for r in derived) == 1
    assert warc.derived_records(spark.createDataFrame([], warc.RECORD)).collect() == []


def test_archives_of_any_name_are_read(spark, tmp_path):
    (tmp_path / "crawl").mkdir()
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "crawl" / "CC-MAIN-0001.warc").write_bytes(record * 2)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r["content"]) for r in rows] == [b"hi", b"hi"]


def test_records_of_a_file_one_after_the_other():
    """Members zipped apart, lines between records, and a record that the file cuts off."""
    record = b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: 3\r\n\r\n\nWA\r\n\r\n"
    assert [c for _, c in warc.records_in(gzip.compress(record) * 3)] == [b"\nWA"] * 3
    assert [c for _, c in warc.records_in(b"odd\r\n" + record + record[:-5])] == [b"\nWA", b"\nW"]
    assert list(warc.records_in(b"")) == [] and list(warc.records_in(b"WARC/1.0\r\nWARC-Type: x")) == [([("WARC-Type", "x")], b"")]
