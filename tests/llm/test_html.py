import re
from html import unescape

import duckdb

from weft.llm import html as H

ARTICLE = "<h1>A title &amp; more</h1><p>First   paragraph,\n with commas, and &eacute;nough text &#x41;&lt;b&gt;.<p>Second <b>bold <i>one</b> here<br>after break.</p>"
TEXT = "A title & more\nFirst paragraph, with commas, and énough text A<b>.\nSecond bold one here after break."


def page(inner):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no</p>'</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home, start, here</a></li></ul></nav><!-- <p>no</p> -->"
        "<div class=\"ad\">Buy, buy, buy now, this long advert text, with many commas, and words, to score.</div>"
        f"{inner}<aside>Side, bar, text, with, commas, many, of, them</aside><form><p>Name, please</p></form>"
        "<div id='cookie-notice'>We use cookies, many, many, many</div>"
        "<section class=\"comments\"><p>Reader, comment, that is long, and has commas, too, many.</p></section>"
        "<footer>&copy; us, 2020</footer></body></html>"
    )


def test_articles():
    assert H.main_text(page(f"<article>{ARTICLE}</article>")) == TEXT
    assert H.main_text(page(f"<div id=content>{ARTICLE}</div>")) == TEXT
    assert H.main_text(page(f"<main><article class='post'>{ARTICLE}<ul><li><a>x</a><li><a>y</a><li><a>z</a></ul></article></main>")) == TEXT
    two = "<article><section><p>One, two.</p></section><section><p>Three, four.</p></section></article>"
    assert H.main_text(page(two)) == "One, two.\nThree, four."
    assert H.main_text(page("<article><p>Be.</p></article>")) == "Be."
    assert H.main_text(page("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>")) == "one\ntwo\na\nb"


def test_parts_of_unequal_length():
    long = "A paragraph, with commas, and words, enough of them, to count, as the text goes on and on."
    parts = [*[long] * 5, "One short paragraph."]
    want = "\n".join(parts)
    five, short = "".join(f"<p>{p}</p>" for p in parts[:5]), f"<p>{parts[5]}</p>"
    divs = "".join(f"<div><p>{p}</p></div>" for p in (long * 9, "Short.", "Shorter."))
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")):
        for part in ("section", "div", "div class=text"):
            inner = f"<{part}>{five}</{part.split()[0]}><{part}>{short}</{part.split()[0]}>"
            assert H.main_text(page(f"{start}{inner}{end}")) == want
        assert H.main_text(page(f"{start}{divs}{end}")) == f"{long * 9}\nShort.\nShorter."


def test_parts_named_like_boilerplate():
    assert H.main_text(page("<article><header><h1>Head</h1></header><p>One, two.</p></article>")) == "Head\nOne, two."
    for part in ("section id=privacy", "div class='related-work'", "section class=discussion", "div class='ad-hoc-networks'"):
        inner = f"<article><p>One, two.</p><{part}><p>Three, four, of some length.</p></{part.split()[0]}></article>"
        assert H.main_text(page(inner)) == "One, two.\nThree, four, of some length."
    links = "<div class='related-work'><a href=a>One thing, or other</a> <a href=b>And more</a></div>"
    notices = "".join(f"<div class='{c}'>Some words, and more.</div>" for c in ("ad", "ad-slot-3", "cookie-notice", "share-links", "comments list"))
    assert H.main_text(page(f"<article><p>One, two.</p>{links}{notices}</article>")) == "One, two."


def test_pages_without_articles():
    """Nothing but the scores tells what is the article here."""
    long = ["A paragraph, with commas, and words, enough of them, to count, as the text goes on and on." * k for k in (3, 2, 4)]
    text = "".join(f"<p>{p}</p>" for p in long)
    want = "\n".join(long)
    links = "".join(f"<p><a href=x{i}>Another story, with a long title, and commas, to read</a></p>" for i in range(9))
    blurb = "<div><p>Who we are.</p><p>Write to us.</p></div>"
    for wrap in ("div class='layout with-sidebar'", "div class=x7", "div id=header-and-body"):
        for content in ("div", "div class=c1", "td"):
            inner = f"<{wrap}><div>{links}</div><{content}>{text}</{content}>{blurb}</{wrap.split()[0]}>"
            assert H.main_text(f"<html><body>{inner}<div>All rights, reserved.</div></body></html>") == want
    deep = "<div>" * 40 + text + "</div>" * 40
    assert H.main_text(f"<body><div>{links}</div>{deep}{blurb}</body>") == want


def test_scores_decide(monkeypatch):
    monkeypatch.setattr(H, "_CONTAINER", frozenset())  # no container gets points: the root is the best
    long = "A paragraph, with commas, and words, enough of them, to count, as the text goes on and on." * 3
    assert H.main_text(f"<body><div><p>Who we are.</p></div><div><p>{long}</p></div></body>") != long
    monkeypatch.undo()
    assert H.main_text(f"<body><div><p>Who we are.</p></div><div><p>{long}</p></div></body>") == long


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<html><script>x") == ""
    assert H.main_text("just text, no markup & such") == "just text, no markup & such"
    assert H.main_text("a < b and c > d <3") == "a < b and c > d <3"
    assert H.main_text("<p title='a > b'>x</p><p class=\"un'closed>y</p>") != ""
    assert H.main_text("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    assert H.main_text("<p>" + "<" * 200000) .startswith("<")
    assert H.main_text("<div>text " * 30000) .count("text") >= 1
    long = "word, " * 200000
    assert H.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_test_pages_match_their_articles(spark):
    rows = duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {r.page_id: r for r in H.op5_tree_scoring(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, html in rows:
        inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert got[i].text == want and got[i].n_chars == len(want)


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (None, "u", "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text", "5 AS extra")
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, "b"), (1, ""), (2, ""), (2, "a"), (2, "a")]
    assert H.extract(df.where("page_id > 9")).count() == 0
