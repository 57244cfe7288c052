import re
import time
from html import unescape

import random

import pytest

from stratafile.llm import html_text as op

P = "One paragraph, with some commas, and more than enough text to be scored as part of the article."
CASES = {
    "article with everything around it": (f"<html><head><title>T</title><style>p{{}}</style></head><body><header><p>Site, name</p></header><nav><ul><li><a href=1>A</a></ul></nav><div class='cookie-notice'><p>We use cookies, ok?</p></div><article><h1>Head &amp; line</h1><p>{P}<p>{P}<div class=ad>Buy, now</div><form><p>Sign, up</p></form></article><aside><p>Side, bar</p></aside><section id=comments><p>{P}</p></section><footer><p>Foot, er</p></footer></body></html>", f"Head & line\n{P}\n{P}"),
    "divs only": (f"<body><div id=sidebar><p>{P}</p></div><div id=content><p>{P}</p><p>{P} <a href=x>link</a></p></div><div class='comment-list'><p>{P}</p><p>{P}</p></div></body>", f"{P}\n{P} link"),
    "link lists lose": (f"<div>{'<p><a href=x>many, many, many links in a row here</a></p>' * 9}</div><div><p>{P}</p><p>{P}</p></div>", f"{P}\n{P}"),
    "white space and references": ("<article><p>a\n\t b&nbsp;&lt;c&gt; &#233;&#x41; &amp &unknown;</p><p> </p><p>d<br>e</p></article>", "a b <c> éA & &unknown;\nd e"),
    "inline markup": ("<article><p>un<b>bro</b>ken <i>words</i></p></article>", "unbroken words"),
    "unclosed": ("<article><p><b>Bold<br><p>Next, one<p>Third</article><footer>f</footer>", "Bold\nNext, one\nThird"),
    "raw text": ("<article><p>a</p><script>if (a < b) document.write('<p>x</p>')</script><p>b</p><!-- <p>c</p> --></article>", "a\nb"),
    "lists": ("<article><p>First, item</p><ul><li>x<li>y</ul></article>", "First, item\nx\ny"),
    "no paragraphs": ("<body>just text<div>more</div></body>", "just text\nmore"),
    "plain": ("plain text", "plain text"),
    "empty": ("", ""),
    "null": (None, ""),
    "only menu": ("<nav><a href=x>y</a></nav>", ""),
    "cut off": ("<article><p>abc</p><p>de&am", "abc\nde&am"),
    "cut tag": ("<article><p>abc</p><p cla", "abc"),
    "bad nesting": ("<article><p>a</div></span>b</p></article></article>", "ab"),
    "long comments below a short article": (f"<article><p>{P}</p></article><div class='comments'>{f'<p>{P} Reply.</p>' * 8}</div>", P),
    "long comments inside the article": (f"<article><p>{P}</p><section class='comments'>{f'<p>{P} Reply.</p>' * 8}</section></article>", P),
    "long comments without an article": (f"<div id=main><p>{P}</p></div><div id=comments>{f'<p>{P} Reply.</p>' * 8}</div>", P),
    "comments that are articles": (f"<main><p>{P}</p></main><ol class=comment-list>{f'<li><article class=comment-body><p>{P}</p></article>' * 9}</ol>", P),
    "badly named wrapper": (f"<div class='page sidebar-layout'><div class=ads>Buy</div><article><p>{P}</p></article></div><p>Stray, text</p>", P),
    "badly named wrapper of a headline": (f"<div class='social page'><div><h1>Head</h1><p>{P}</p></div></div>", f"Head\n{P}"),
    "badly named article": (f"<article class='post comments-open'><p>{P}</p></article><div class=comments><p>{P}</p></div>", P),
    "quote in a bare value": (f"<article><p>{P} <a href=x's>link</a></p><p>It's next.</p></article>", f"{P} link\nIt's next."),
    "quotes around tags": ("<article><p title='a > b' class=\"c>d\">text</p><p data-x = 'e>f'>more</p></article>", "text\nmore"),
    "inline ends stay in their cell": ("<article><b>x<table><tr><td>cell</b> on<td>next</table></article>", "x\ncell on\nnext"),
    "rows and cells close": ("<article><table><tr><td>a<td>b<tr><th>c<tbody><tr><td>d</table><dl><dt>e<dd>f<dt>g</dl></article>", "a\nb\nc\nd\ne\nf\ng"),
    "class that covers all": (f"<body class=comments><div class='post comments'><p>{P}</p></div></body>", P),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, text = CASES[name]
    assert op.main_text(html) == text


def test_deep_and_long_pages():
    assert op.main_text("<div>" * 20_000 + "<p>deep, text</p>") == "deep, text"
    assert op.main_text("<article>" + f"<p>{P}</p>" * 5000 + "</article>") == "\n".join([P] * 5000)


@pytest.mark.parametrize("hostile", ["<div>" * 100_000 + "</b>" * 100_000, "<b><table>" + "<div>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<header>" * 50_000, "<a b='" * 50_000, "<!--" * 50_000 + "<x " * 50_000])
def test_hostile_pages_take_time_in_proportion(hostile):
    began = time.perf_counter()
    op.main_text(hostile + "x")
    assert time.perf_counter() - began < 4


def test_pages_whose_article_is_a_plain_block(spark):
    """Without an article element only the scores can tell the article: the same text must come."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = op.main_text(r.html)
        for tag in ("<div>", "<section>"):
            other = r.html.replace("<article>", tag).replace("</article>", tag.replace("<", "</"))
            other = other.replace("<nav>", "<div><p><a href=x>One, two</a> <a href=y>three</a></p>").replace("</nav>", "</div>")
            assert op.main_text(other) == want, r.page_id


def test_all_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = op.extract(pages).collect()
    assert len(got) == len(html)
    for r in got:
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S).group(1)
        blocks = (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert op.extract(pages.limit(0)).collect() == []
    assert sorted((tuple(r) for r in op.extract(pages).collect()), key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)], key=str)


P1, P2 = "The first paragraph, with commas, is long enough to be taken for prose by any rule that counts.", "The second paragraph goes on, at some length, about the same matter, and then it ends."
ARTICLE = f"<h1>Head</h1><p>{P1}</p><p>{P2}</p>"


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><form><div id=content>{ARTICLE}</div></form></body>", f"Head\n{P1}\n{P2}"),
        (f"<body><nav>menu</nav><form action=x><input><article>{ARTICLE}</article></form></body>", f"Head\n{P1}\n{P2}"),
        (f"<body><div role=alert><article>{ARTICLE}</article></div><footer>foot</footer></body>", f"Head\n{P1}\n{P2}"),
        (f"<body><form><div><p>{P1}</p><p>{P2}</p></div></form></body>", f"{P1}\n{P2}"),
        (f"<body><form><p>Subscribe, please, to our long and wonderful newsletter, every day.</p></form><article>{ARTICLE}</article></body>", f"Head\n{P1}\n{P2}"),
        (f"<body><article><p>{P1} <label>a label</label> and <math><mi>x</mi>=1</math></p><p>{P2}</p><label>Search</label></article></body>", f"{P1} a label and x=1\n{P2}"),
        (f"<body><article>{ARTICLE}<div class='side note'><p>Noted.</p></div><section class=tags><p>Tagged.</p></section></article></body>", f"Head\n{P1}\n{P2}\nNoted.\nTagged."),
        (f"<body><div><h1>Head</h1><h3>Sub</h3><ul><li>one</li></ul><table><tr><td>cell</td></tr></table><div class=x><p>{P1}</p><p>{P2}</p></div><h3>After</h3><blockquote>Quoted, at last, by someone.</blockquote></div></body>", f"Head\nSub\none\ncell\n{P1}\n{P2}\nAfter\nQuoted, at last, by someone."),
        (f"<body><article>{ARTICLE}<section><h2>3 Comments</h2><p>I don't agree, not at all, with this.</p></section></article></body>", f"Head\n{P1}\n{P2}"),
        (f"<body><article>{ARTICLE}<section><h2>Comments on the law</h2><p>{P1}</p></section></article></body>", f"Head\n{P1}\n{P2}\nComments on the law\n{P1}"),
        (f"<body><header><form role=search><input><label>Find</label></form><h1>Site</h1></header><div id=content><p>{P1}</p><p>{P2}</p></div></body>", f"{P1}\n{P2}"),
        ("<body><form><input><button>Go</button></form></body>", ""),
    ],
)
def test_pages_that_hide_their_article(html, want):
    assert op.main_text(html) == want


def page(rnd):
    """(html, text) of a page whose article is known: blocks of all kinds, in one of many wrappings, among all that doesn't belong to it."""
    words = lambda n: " ".join(rnd.choice(["stone", "river", "of", "the", "light,", "a", "walk", "home,"]) for _ in range(n))
    blocks = [("h1", words(4))] + [("p", words(rnd.randint(30, 60)) + ".") for _ in range(rnd.randint(2, 5))]
    for kind in rnd.sample(["h2", "h3", "li", "blockquote", "pre", "td"], rnd.randint(0, 4)):
        blocks.insert(rnd.randint(2, len(blocks)), (kind, words(rnd.randint(3, 12))))
    if blocks[-1][0] != "p":
        blocks.append(("p", words(40) + "."))
    around = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}
    inner = "\n".join(around.get(k, f"<{k}>{{}}</{k}>").format(t) for k, t in blocks)
    noise = [
        f"<nav><ul><li><a href=/>{words(3)}</a></li></ul></nav>", f"<aside><p>{words(30)}</p></aside>", f"<div class='sidebar'><p>{words(40)}</p></div>", f"<footer><p>{words(20)}</p></footer>", f"<div id=comments><p>{words(50)}</p></div>",
        f"<script>var x = '<p>{words(40)}</p>';</script>", f"<div class='ad banner'>{words(9)}</div>", f"<div class=cookie-notice><p>{words(3)}</p></div>", "<form><input><button>Go</button></form>", f"<ul class=menu><li><a href=a>{words(2)}</a><li><a href=b>{words(2)}</a></ul>", f"<header>{words(5)}</header>", f"<div role=navigation>{words(8)}</div>",
    ]
    rnd.shuffle(noise)
    cut = rnd.randint(0, 6)
    wrap = rnd.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>", "<div class=post-body><div>{}</div></div>", "<form><article>{}</article></form>", "<form><div class=entry>{}</div></form>", "<div role=alert><main>{}</main></div>"])
    body = "".join(noise[:cut]) + wrap.format(inner) + "".join(noise[cut : cut + 5] if "<form" not in wrap else [x for x in noise[cut : cut + 5] if "<form" not in x])
    return f"<html><head><title>t</title></head><body>{body}</body></html>", "\n".join(" ".join(t.split()) for _, t in blocks)


@pytest.mark.parametrize("seed", range(60))
def test_pages_whose_article_is_known(seed):
    html, want = page(random.Random(seed))
    assert op.main_text(html) == want
