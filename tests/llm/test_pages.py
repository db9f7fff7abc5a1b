"""op1: inline markup, wrappers of every mark, and all given pages with inline markup added."""

import random
import re

import pytest

from redactflow.llm import html_extract as H

LONG = "long words of it " * 40
PARAGRAPHS = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
TEXT = ["Head", LONG.strip(), LONG.strip()]


@pytest.mark.parametrize(("html", "text"), [
    ("<p>Hello <b>bold</b> world and <a>a link</a>, then more.</p>", "Hello bold world and a link, then more."),
    ("<p>H<sub>2</sub>O</p>", "H2O"), ("<p><i>a</i><b>b</b> c</p>", "ab c"), ("<p>a<br>b<br/>c</p>", "a b c"), ("<p>a <b>b<p>c</b> d", "a b\nc d"),
    ("<p>one <span>two <em>three</em></span> four<img src=x> five</p>", "one two three four five"), ("<a href=x><div>in</div></a> out", "in\nout"),
    ("<p>read <span class='ad'>buy</span> on <button>Go</button> there</p>", "read on there"), ("<li>a <code>b</code><li><a>c</a> d", "a b\nc d"),
    ("<p>x</i> y</b> z</p>", "x y z"), ("<p>a<script>var b='</p>'</script>c</p>", "ac"), ("<td>a <b>1</b></td><td>b</td>", "a 1\nb")])
def test_inline_elements_end_no_line(html, text):
    assert H.extract(html) == text


@pytest.mark.parametrize("mark", [*sorted(H.MARKS), "notice legal", "post-comment", "social", "with-sidebar", "main-content widget"])
@pytest.mark.parametrize("how", ["class", "id"])
def test_a_marked_element_that_holds_the_article_is_kept(mark, how):
    html = f'<body>Site name<div {how}="{mark}">{PARAGRAPHS}<div class="sidebar"><p>links and more</p></div></div><div class="ad"><p>Buy now</p></div></body>'
    assert H.extract(html).split("\n") == ["Site name", *TEXT] or H.extract(html).split("\n") == TEXT


@pytest.mark.parametrize("mark", sorted(H.MARKS))
def test_a_marked_element_beside_the_article_is_dropped(mark):
    more = "words of no article " * (30 if mark in H.COMMENTS else 12)
    assert H.extract(f'<body><div>{PARAGRAPHS}</div><div class="{mark}"><p>{more}</p><p>{more}</p></div></body>').split("\n") == TEXT


def test_pages_in_one_form():
    for inner in (PARAGRAPHS, f"<article>{PARAGRAPHS}</article>", f'<div class="body">{PARAGRAPHS}</div>'):
        html = f'<body><form id="aspnet"><div class="menu">Menu</div>{inner}<div class="comments"><p>{"Nice one. " * 20}</p></div></form></body>'
        assert H.extract(html).split("\n") == TEXT
    assert H.extract(f"<body><div>{PARAGRAPHS}</div><form><p>Your name and a few words</p></form></body>").split("\n") == TEXT


def test_role_and_hidden():
    assert H.extract(f'<body><div role="search"><p>find</p></div>{PARAGRAPHS}<div hidden><p>{LONG * 9}</p></div><p style="display:none">{LONG}</p></body>').split("\n") == TEXT
    assert H.extract(f'<body><div role="form">{PARAGRAPHS}</div></body>').split("\n") == TEXT


def test_chrome_alone_is_no_text():
    assert H.extract("<nav>menu</nav><div class='sidebar'><ul><li>links</li></ul></div><div class='cookie'><p>We use cookies</p></div>") == ""


def test_given_pages_with_inline_markup(spark):
    """Marking up words within paragraphs changes no page's text."""
    r = random.Random(1)
    forms = ["{}", "{}", "<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "<code>{}</code>", "<span class='x'>{}</span>"]
    word = re.compile(r"\b([A-Za-z]{3,})\b(?![^<]*>)(?![^&\s]*;)")
    pages = [x.html for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    changed = 0
    for html in pages:
        more = re.sub(r"<p>[^<]*", lambda p: word.sub(lambda w: r.choice(forms).format(w.group()), p.group()), html)
        changed += more != html
        assert H.extract(more) == H.extract(html)
    assert changed > 200
