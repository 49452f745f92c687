"""Main text of pages: made pages of several templates whose article is known, odd markup, and the given pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from labelmill.llm import extract

PAGES = "page_id long, url string, html string"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rnd, template, paragraphs):
    """A page and its article's text."""
    junk = lambda n: prose(rnd, n)
    parts = [prose(rnd, rnd.randrange(8, 40)) + rnd.choice(["", " 1 < 2 & 3 > 2", " “é”"]) for _ in range(paragraphs)]
    inner = "".join(rnd.choice(["<p>%s</p>", "<p>%s", "<p><b>%s<br>", "<p>%s\n\n</p>\n"]) % html.escape(p) for p in parts)
    head = f"<!doctype html><html><head><title>{junk(4)}</title><style>p{{}}</style><script>var t = '</p><article>';</script></head>"
    menu = "".join(f'<li><a href="/{k}">{junk(2)}</a></li>' for k in range(6))
    comments = f'<div class="comment-list"><p>{junk(30)}</p><p>{junk(30)}</p></div>'
    body = {
        "article": f'<nav><ul>{menu}</ul></nav><div class="ad">{junk(20)}</div><article>{inner}</article><aside>{junk(40)}</aside><footer>{junk(9)}</footer>',
        "divs": f'<div id="wrap"><div class="col-{rnd.randrange(9)}">{junk(12)}</div><div class="story body-{rnd.randrange(99)}">{inner}<form>{junk(3)}<input></form></div><div class="x">{junk(12)}</div></div>{comments}',
        "main": f'<header><h1>{junk(3)}</h1></header><main><ul>{menu}</ul><section class="text">{inner}</section></main><div id="cookie-notice">{junk(30)}</div><section class="comments"><article class="comment">{junk(60)}</article></section>',
        "inline": f'<div class="topnav">{junk(8)}</div><article>{inner.replace("Lorem", "<span class=share>Share</span><i>Lorem</i>")}<div style="display: none">{junk(60)}</div>{comments}</article>',
    }[template]
    return head + "<body>" + body + rnd.choice(["</body></html>", "", "</bo"]), "\n\n".join(" ".join(p.split()) for p in parts)


def test_articles_of_several_templates(spark):
    rnd, rows, want = random.Random(3), [], {}
    templates = ["article", "divs", "main", "inline"]
    for k in range(600):
        host = 0 if rnd.random() < 0.33 else rnd.randrange(1, 25)
        # A few pages hold less text than the boxes around it: their own container would be too wide.
        source, text = page(rnd, templates[host % 4], rnd.choice([1, 4, 8, 12]) if host % 4 != 1 or k % 5 else 1)
        want[k] = text
        rows.append((k, f"https://H{host}.example.com:8080/a/{k}?x=1", source))
    found = extract.extract(spark.createDataFrame(rows, PAGES).repartition(5))
    got = {r["page_id"]: r["text"] for r in found.collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), rows[wrong[0]], got[wrong[0]], want[wrong[0]])
    joined = extract.extract(spark.createDataFrame(rows, PAGES), broadcast_bytes=0)
    assert {r["page_id"]: r["text"] for r in joined.collect()} == got


def test_a_short_page_follows_its_host(spark):
    box = "<div class=box>" + "advice " * 30 + "</div>"
    wide = [(k, "http://a.example/x", f"<body>{box}<div class='t{k}'><p>{'long text ' * 200}</p></div></body>") for k in range(7)]
    short = (9, "http://a.example/y", f"<body>{box}<div class='t7'><p>Short.</p></div></body>")
    alone = (10, "http://b.example/y", short[2])
    got = {r["page_id"]: (r["text"], r["path"]) for r in extract.extract(spark.createDataFrame([*wide, short, alone], PAGES)).collect()}
    assert got[9] == ("Short.", "html>body>div.t#") and "advice" in got[10][0]
    won = {r["host"]: r["paths"] for r in extract.winners(extract.votes(spark.createDataFrame([*wide, short, alone], PAGES))).collect()}
    assert won["a.example"] == ["html>body>div.t#"]


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("plain text", "plain text"), ("<p>a &amp;&lt; b&nbsp;c &#233;&#x1F642; &am", "a &< b c é\U0001f642 &am"), ("<p>one<br>two<p>three", "one two\n\nthree"), ("<p>cut off <b", "cut off"), ("<p>x</p><!-- never closed <p>y", "x"),
    ("<p>1 < 2 <3 and <> done", "1 < 2 <3 and <> done"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<table><tr><td>a<td>b<tr><th>c</table>d", "a\n\nb\n\nc\n\nd"), ("<p title='a>b'>x</p>", "x"), ('<p class="ad">x</p>y', "y"),
    ("<script>if (a</b) '</p>'</SCRIPT >z", "z"), ("<textarea><p>x</textarea>y", "y"), ("<div hidden>x</div><span aria-hidden=true>y</span>z", "z"), ("<body class='with-sidebar'><div class='post no-comments'>x</div>", "x"),
    ("a<b>b</b>c <i>d</i>\n e", "abc d e"), ("<p>a</div></span>b", "ab"), ("<article><header><h1>T</h1></header><p>x</article>", "T\n\nx"), ("<b><p>x</b>y</p>z", "xy\n\nz"), (" \n<br> ", ""), ("<p>a\x00b", "a\x00b"),
    ("<div class='Post-Body'><p>x</p></div><div class='post-footer'>y</div><div class=adBox>z</div>", "x"),
])
def test_odd_markup(source, want):
    p = extract.Page(source)
    assert p.text(0) == want


def test_rows_of_any_kind(spark):
    rows = [(1, None, "<p>a"), (1, "no host", "<p>a"), (None, "http://x.example/", None), (2, "http://x.example/", ""), (2, "http://x.example/", "<p>b<p>b"), (2, "http://x.example/", "<p>b<p>b"), (3, "http://user:pw@X.example:1/", "<nav>only</nav>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"Text": F.lit(1), "PATH": F.lit("x"), "host": F.lit("h"), "paths": F.lit(5)})
    out = extract.extract(df)
    assert out.columns == ["page_id", "url", "html", "host", "paths", "text", "n_chars", "path"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0), (2, "b\n\nb", 4), (2, "b\n\nb", 4), (3, "", 0)]
    assert extract.extract(df.limit(0)).count() == 0


def test_hostile_pages_cost_no_more_than_their_length():
    import time

    for unit in ('<a b="', "<p", "<div>", "<b><div>", "</b>", "<p><table><tr><td><div>", "<ul><li>", "<!--", "<script>", "&amp", "<a href='x", "<b>", "<a =", "<div class=a1>", "<p><i>", "<td>", "<li></ul>"):
        began = time.time()
        p = extract.Page(unit * (150_000 // len(unit)))
        p.text(p.container())
        assert time.time() - began < 15, unit
    began = time.time()
    extract.Page("<b><div>" + "<i>" * 20_000 + "</b>" * 20_000)
    assert time.time() - began < 15


def test_given_pages_by_a_plain_reading(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    out = extract.op13_extract(spark, d)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
