import html
import re

from tests.llm.conftest import by_id
from tidewatch.llm.html_text import best_path, extract, extract_text, winning_paths

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var t="</p><p>bad";</script></head><body class="home page-7"><header><h1>Site</h1></header>
<nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div><div id="wrap"><div class="sidebar">side text here</div>
<div class="post-content entry-123"><h1>Title &amp; more</h1><p>First <b>bold</b>er para&nbsp;graph<br>line two<p>Second &lt;tag&gt; paragraph with   spaces
and lines, long enough to win. a < b and 3<4</p><ul><li>one<li>two</ul><form>form text</form><div class=ad>buy</div><blockquote>Quote</blockquote>
<table><tr><td>a<td>b</table><!-- hid <p>x</p> --><p hidden>unseen</p><pre>pre text</pre></div><section class="comments"><article class=comment>
<p>Reader says a lot of things here, and then a lot more than that.</p></article></section></div><footer>foot</footer></body></html>"""
TEXT = "Title & more\nFirst bolder para graph line two\nSecond <tag> paragraph with spaces and lines, long enough to win. a < b and 3<4\none\ntwo\nQuote\na\nb\npre text"


def test_one_page():
    assert best_path(PAGE)[0] == "html/body/div/div.entry-#.post-content"
    assert extract_text(PAGE, [])[0] == TEXT


def test_classes_of_neighbours_and_forms():
    text = "<p>" + "The words of the story. " * 5 + "</p>"
    for page in (
        f"<div class='content has-sidebar'>{text}</div>", f"<article class='post widget'>{text}<article class='comment'>{text}</article></article>",
        f"<form id=all><div>{text}</div></form>", f"<div class='post'>{text}</div><form><p>{'Fill in. ' * 40}</p></form>",
    ):
        assert extract_text(page, [])[0] == ("The words of the story. " * 5).strip(), page


def test_text_beside_the_largest_container():
    text = "The words of the story. " * 40
    said = text.strip()
    for inner in ("<h1>Title</h1><p>Lead</p>", "<header><h1>Title</h1></header><p>Lead</p>"):
        for kind in ("article", "main"):
            page = f"<body><div>menu</div><{kind}>{inner}<div class='article-body'><p>{text}</p></div></{kind}></body>"
            assert extract_text(page, [best_path(page)[0]])[0] == f"Title\nLead\n{said}"
    two = f"<section class='a'><p>{text}</p></section><section class='b'><p>Short end.</p></section>"
    for page in (f"<article><h1>Title</h1>{two}</article>", f"<body><div class='page'><h1>Title</h1>{two}</div><div>beside</div></body>"):
        assert extract_text(page, [best_path(page)[0]])[0] == f"Title\n{said}\nShort end."


def test_containers_named_as_main_text_are_taken_whole():
    text = "The words of the story. " * 40
    said = text.strip()
    for page in (
        f"<body><div class=post><h1>Title</h1><p>Lead</p><div class=entry-body><p>{text}</p></div></div><div>beside</div></body>",
        f"<body><div class=content><h1>Title</h1><div class=a><p>Lead</p></div><div class=b><p>{text}</p></div></div><div>beside</div></body>",
    ):
        assert extract_text(page, [best_path(page)[0]])[0] == f"Title\nLead\n{said}"
    # What is mostly links, or not named as text, stays outside.
    links = "<a href=x>One of many links</a> " * 9
    for page in (f"<body><div id=main><div>{links}</div><div class=b><p>{text}</p></div></div></body>", f"<body><div class=wrap><p>Lead</p><div class=b><p>{text}</p></div></div></body>"):
        assert extract_text(page, [best_path(page)[0]])[0] == said


def test_ids_of_chapters_do_not_drop_them():
    text = "<p>" + "The words of the story. " * 20 + "</p>"
    page = f"<article>{text}<section id='discussion'><h2 id='related-work'>Related</h2><p>More.</p></section><h2 id=search-methods>Search</h2><section id=comments><p>Reader.</p></section></article>"
    assert extract_text(page, [])[0].split("\n")[1:] == ["Related", "More.", "Search"]
    assert extract_text(f"<div class=post>{text}<h2 id=notice>Notice</h2><p class='ad'>Buy</p></div>", [])[0].split("\n")[1:] == ["Notice"]


def test_broken_markup_ends():
    for page in ("", "<", "<p", "<!-- open", "<script>x", "<p title='a>b", "a <b <c> d", "</p></div>text", "<div>" * 3000 + "x" + "</div>" * 10):
        assert isinstance(extract_text(page, [])[0], str)
    assert extract_text("just text &eacute; &#8364; &#x41;", [])[0] == "just text é € A"


def test_host_consensus_overrules_a_page(make):
    """A page whose comment-like box is longer than its article is read along the host's path."""
    def page(body, box):
        return f"<html><body><div class='story-{len(body)}'><p>{body}</p></div><div class='box'><p>{box}</p></div></body></html>"

    pages = [(i, f"https://www.Host.example/{i}", page("story words here, " * 9, "small")) for i in range(9)]
    pages += [(9, "http://host.example/odd", page("A short story.", "a much longer box of other things, " * 9))]
    pages += [(10, "http://alone.example/odd", page("A short story.", "a much longer box of other things"))]
    table = make(pages, "page_id long, url string, html string")
    got = by_id(extract(table), "page_id", "text")
    assert got[9] == ["A short story."] and got[0] == [("story words here, " * 9).strip()]
    assert got[10] == ["a much longer box of other things"]
    assert by_id(extract(table, broadcast_chars=0), "page_id", "text") == got
    assert {r["host"] for r in winning_paths(table).collect()} == {"host.example", "alone.example"}


def test_edge_rows(make):
    rows = [(1, None, None), (2, "no host", ""), (3, None, PAGE), (3, None, PAGE), (None, "http://a.b/", PAGE), (4, "http://a.b/", "<article>" + "<p>word &amp; " * 50_000)]
    got = by_id(extract(make(rows, "page_id long, url string, html string")), "page_id", "url", "text")
    assert got[1] == [(None, "")] and got[2] == [("no host", "")]
    assert got[3] == [(None, TEXT)] * 2 and got[None] == [("http://a.b/", TEXT)]
    assert got[4][0][1] == "\n".join(["word &"] * 50_000)
    assert extract(make([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark):
    """All pages against a reading that knows their one template."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = by_id(extract(pages), "page_id", "text")
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[row["page_id"]] == ["\n".join(b for b in blocks if b)]
